"""URL decisions against plain Python with urllib, and against their SQL."""

from __future__ import annotations

import random
import re
from urllib.parse import urljoin

import duckdb
import pytest

from merchlife.llm import urlfilter
from verification.compare import difference

SCHEMA = "page_id long, url string, html string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as verdict", "3 as node", "'t' as tag")


def judged(df, **more):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, **more).collect()}


def test_decisions(spark):
    rows = [
        (1, "http://a.example.com/de/1", None),
        (2, "https://www.a.example.com/en/9/", '<link rel="canonical" href="http://a.example.com/de/1?utm_source=x">'),
        (3, "http://b.org/fr/", "<meta http-equiv='refresh' content='0; url=http://a.example.com/de/1'>"),
        (4, "http://c.org/x", "<LINK href=/y rel=canonical>"),
        (5, "http://c.org/y", None),
        (6, "no scheme", "<link rel=canonical href=http://a.example.com/de/1>"),
        (7, None, None),
        (8, "HTTP://EXAMPLE.NET/en/?q", None),
        (9, "http://sub.example.net", None),
        (10, "http://d.com/1", '<link rel="canonical" href="http://x.example.com/de/2">'),
        (10, "http://d.com/1", None),
        (11, "http://x.example.com/de/2", None),
        (20, "http://a.xx/1", '<link rel="canonical" href="http://foo.net/x">'),  # the target is no page
        (21, "http://a.xx/2", "<meta http-equiv=refresh content='5;URL=http://foo.net/y'>"),
        (22, "http://b.xx/z", "<link rel='nofollow Canonical' href='http://a.xx/2'>"),
        (23, "http://c.xx/dir/page?q", '<p><link rel="canonical" href="?r"><link rel="canonical" href="../up/./there">'),  # all links count
        (24, "http://c.xx/up/there", '<link data-href="http://foo.net/" rel=canonical href="//bar.net/&amp;a=1#top">'),
        (25, "http://c.xx/dir/page?r", None),
        (26, "http://e.xx/1", '<link rel="canonical" href="mailto:x@foo.net"><link rel=canonical href="#top"><link rel=canonical href=""><link rel="canonical">'),
        (27, "http://e.xx/2", '<link rel="stylesheet" href="http://foo.net/x"><a rel="canonical" href="http://foo.net/x">'),
    ]
    got = judged(frame(spark, rows))
    assert got[1] == ("a.example.com", "/de/1", "example.com/de/", "block")
    assert got[2] == ("www.a.example.com", "/en/9/", None, "allow")  # its component holds an allowed URL
    assert got[3] == ("b.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("c.org", "/y", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("example.net", "/en/", "example.net/en/", "allow")
    assert got[9] == ("sub.example.net", "", None, "allow")
    assert got[10] == ("d.com", "/1", None, "block")
    assert [got[i][3] for i in (20, 21, 22, 23, 24, 25, 26, 27)] == ["block"] * 6 + ["allow"] * 2
    more = spark.createDataFrame([("http://c.org/y", "http://x.example.com/de/2"), (None, "http://c.org/y")], "source string, target string")
    assert judged(frame(spark, rows), redirects=more)[4][3] == "block"
    assert urlfilter.judge(frame(spark, rows).limit(0)).count() == 0


LINKS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g?y/../x", "g#s", "g?y#s", ";x", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "x" * 5000 + "/.." * 300]


def test_links_resolve_as_rfc_3986_says(spark):
    cases = [(base, link) for base in ("http://a/b/c/d;p?q", "https://Host:8080", "http://a/b/") for link in LINKS]
    df = spark.createDataFrame([*cases, ("http://a/b", "http://x/y/../z"), ("http://a/b", "data:x"), ("http://a/b", "#s"), ("http://a/b", "")], "url string, link string")
    got = {(r[0], r[1]): r[2] for r in df.select("url", "link", urlfilter.resolved("url", "link")).collect()}
    assert {c: got[c] for c in cases} == {(base, link): urljoin(base, link) for base, link in cases}
    assert [got["http://a/b", x] for x in ("http://x/y/../z", "data:x", "#s", "")] == ["http://x/y/../z", None, None, None]


def made_pages(seed):
    rng = random.Random(seed)
    hosts = [f"h{i}.xx" for i in range(30)] + ["a.xx", "www.a.xx", "b.xx", "foo.net", "example.net", "x.example.com", "c.org", "d.org:80", "foo.net"]
    paths = ["", "/", "/1", "/de/1", "/en/", "/fr/x", "/a/b/c"]
    url = lambda: rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "", "?q", "?utm_a=1", "#f"])
    link = lambda: rng.choice([url(), "../x", "/1", "?q", "//b.xx/1", "y/./z", "mailto:a@b", "#", "/a/b/../c"])
    tag = lambda: rng.choice(['<link rel="canonical" href="{}">', "<link href='{}' rel='x canonical'>", "<meta http-equiv=refresh content='0;url={}'>", '<link rel="icon" href="{}">']).format(link())
    rows = [(i, url() if rng.random() < 0.95 else rng.choice([None, "bad", ""]), "".join(tag() for _ in range(rng.choice([0, 0, 1, 1]))) or None) for i in range(80)]
    return rows


def brute(rows):
    parts = re.compile(r"^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)

    def split(url):
        m = parts.match(url or "")
        return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")

    def normal(url):
        host, path, query = split(url)
        query = re.sub(r"^&+", "", re.sub(r"(^|&)utm_[^&]*", "", query))
        return re.sub(r"^www\.|:(80|443)$", "", host) + path.rstrip("/") + ("?" + query if query else "")

    def rule(url):
        host, path, _ = split(url)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    near, urls = {}, {u for _, u, _ in rows if u and "://" in u}
    for _, url, html in rows:
        if not url or "://" not in url:
            continue
        for tag in re.findall(r"<(?:link|meta)[^>]*>", html or ""):
            found = re.search(r"""href=["']([^"']*)|url=([^']*)""", tag)
            if "canonical" not in tag and "refresh" not in tag:
                continue
            link = found[1] or found[2] or ""
            if link.startswith("#") or not link or link.startswith("mailto"):
                continue
            target = link if "://" in link else urljoin(url, link)
            urls.add(target)
            near.setdefault(normal(url), set()).add(normal(target))
            near.setdefault(normal(target), set()).add(normal(url))
    out = {}
    for i, url, _ in rows:
        host, path, _ = split(url)
        name, verdict = rule(url)
        if verdict is None:
            verdict = "allow"
            if url in urls:
                seen, todo = {normal(url)}, [normal(url)]
                while todo:
                    for x in near.get(todo.pop(), ()):
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                verdicts = {rule(u)[1] for u in urls if normal(u) in seen}
                verdict = "block" if "block" in verdicts and "allow" not in verdicts else "allow"
        out[i] = (host, path, name, verdict)
    return out


@pytest.mark.parametrize("seed", [1, 4])
def test_random_pages_against_plain_python_and_sql(spark, tmp_path, seed):
    rows = made_pages(seed)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    assert judged(pages) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert difference(urlfilter.judge(pages), con, urlfilter.oracle()) is None
    assert len(set(brute(rows).values())) > 10 and {v[3] for v in brute(rows).values() if v[2] is None} == {"allow", "block"}
