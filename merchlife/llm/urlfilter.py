"""URL decisions with redirect equivalence.

A rule (host, path prefix) fits its host and all subdomains; the longest that fits decides. URLs
that lead to one another are aliases: connected components over redirects, over all canonical links and
refreshes found in pages, and over the normal form of a URL (no scheme, ``www.``, default port,
trailing slash, fragment or utm parameters). Links are resolved against their page's URL as RFC 3986
says. A URL with a rule has that rule's verdict; so has a URL that only a link or redirect names. One
without is blocked if its component holds a blocked URL and no allowed one: an explicit allow takes
precedence.

Only DataFrame and SQL functions. Rules are joined on host suffixes, so their number does not matter.

Defined cases. Null URLs and such without ``://``: host and path are empty, they fit no rule, have
no alias and are allowed. Null html: no links. A redirect with a null or malformed end is left out.
Repeated rows each get their verdict. Columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlife.llm.components import connected_components
from merchlife.llm.decontam import LOWER, UPPER, fold
from merchlife.llm.storage import Workspace, small

# Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
# Tags that may hold a link, and their attributes; raw angle brackets are in no URL.
TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
ATTRIBUTE = r"(?is)[\s\x22\x27/]{}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))"
REFRESH = r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[\x22\x27]?([^\x22\x27]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ORIGIN = r"(?s)^(.*?://[^/?#]*)"


def host_of(url: str = "url") -> Column:
    return fold(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def normal_form(url: str) -> Column:
    """What stays the same among the usual spellings of a URL; null for what is no URL."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, QUERY, 1), r"(^|&)utm_[^&]*", ""), r"^&+", "")
    return F.when(F.col(url).contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url)``, distinct, with host, path, and rule and verdict of the longest rule(verdict, host, path) that fits."""
    split = urls.withColumn("host", host_of()).withColumn("path", path_of())
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = split.where("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host"))
    given = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).where("verdict is not null and rule_host is not null and rule_path is not null")
    fits = asked.join(small(given, 100_000), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(name), F.length("rule_host"), (F.col("verdict") == "allow"), name.alias("rule"), F.col("verdict"))).alias("best"))
    return split.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def attribute(tag: str, name: str) -> Column:
    """The value of an attribute in a tag, '' if it has none."""
    return F.trim(F.concat(*(F.regexp_extract(tag, ATTRIBUTE.format(name), i) for i in (1, 2, 3))))


def without_dots(path: str) -> Column:
    """RFC 3986, 5.2.4, for a path that starts with a slash."""
    ends = f"if({path} rlike '(^|/)[.]{{1,2}}$', concat({path}, '/'), {path})"
    step = "case when x = '.' then s when x = '..' then slice(s, 1, greatest(size(s) - 1, 1)) else concat(s, array(x)) end"
    plain = f"array_join(aggregate(slice(split({ends}, '/', -1), 2, length({ends})), array(''), (s, x) -> {step}), '/')"
    return F.expr(f"if({path} rlike '/[.]{{1,2}}(/|$)', {plain}, {path})")


def resolved(base: str, link: str) -> Column:
    """The URL that ``link`` names in a page with URL ``base``; null if that is none or the page itself."""
    origin, path = f"regexp_extract({base}, r'{ORIGIN}', 1)", f"regexp_extract({base}, r'{PATH}', 1)"
    head = f"regexp_extract({link}, r'(?s)^([^?#]*)', 1)"
    rest = f"substring({link}, length({head}) + 1)"
    folder = f"regexp_extract({path}, r'(?s)^(.*/)', 1)"
    whole = f"case when startswith({link}, '/') then {head} when {folder} = '' then concat('/', {head}) else concat({folder}, {head}) end"
    own = F.when(F.expr(f"startswith({link}, '?')"), F.expr(f"concat({origin}, {path}, {link})"))
    own = own.when(F.expr(f"{link} = '' or startswith({link}, '#')"), F.lit(None).cast("string"))
    own = own.when(F.expr(f"startswith({link}, '//')"), F.expr(f"concat(regexp_extract({base}, r'(?s)^(.*?:)//', 1), {link})"))
    own = own.when(F.expr(f"{link} rlike r'{SCHEME}'"), F.when(F.expr(f"{link} like '%://%'"), F.expr(link)))
    return own.otherwise(F.concat(F.expr(origin), without_dots(f"({whole})"), F.expr(rest)))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): each page's URL and the URLs that its canonical links and refreshes name."""
    tags = pages.where("url like '%://%'").select("url", F.explode(F.expr(f"regexp_extract_all(html, r'{TAG}', 0)")).alias("tag")).distinct()
    canonical = F.concat(F.lit(" "), F.lower(F.regexp_replace(attribute("tag", "rel"), r"\s+", " ")), F.lit(" ")).contains(" canonical ")
    refresh = F.lower(attribute("tag", "http-equiv")) == "refresh"
    named = tags.select("url", F.when(F.lower(F.substring("tag", 2, 4)) == "link", F.when(canonical, attribute("tag", "href"))).otherwise(F.when(refresh, F.trim(F.regexp_extract(attribute("tag", "content"), REFRESH, 1)))).alias("link"))
    named = named.where("link is not null").withColumn("link", F.regexp_replace("link", "(?i)&amp;", "&"))
    return named.select("url", resolved("url", "link").alias("target")).where("target is not null").distinct()


def judge(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages(page_id, url, html)``; ``redirects(source, target)``: further edges."""
    spark = pages.sparkSession
    space = Workspace(spark, "urlfilter")
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string") if rules is None else rules
    links = space.save(page_links(pages.select("url", "html")), "links")
    edges = links.select(normal_form("url").alias("a"), normal_form("target").alias("b"))
    known = pages.select("url").union(links.select("target"))
    if redirects is not None:
        edges = edges.union(redirects.select(normal_form("source"), normal_form("target")))
        known = known.union(redirects.select("source")).union(redirects.select("target"))
    parts = connected_components(space, edges)
    urls = space.save(ruled(known.where("url is not null").distinct(), rules).withColumn("node", normal_form("url")), "urls")
    placed = urls.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    marks = placed.where("verdict is not null and part is not null").groupBy("part").agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"))
    held = placed.join(marks, "part", "left")
    judged = held.select("url", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")).alias("verdict"))
    # A URL that many pages have is asked for once and joined back; adaptive execution splits its pages.
    out = pages.select("page_id", "url").join(judged, "url", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for ``judge`` over pages."""
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    host = lambda u: low(f"coalesce(regexp_extract({u}, '{HOST}', 1), '')")
    path = lambda u: f"coalesce(regexp_extract({u}, '{PATH}', 1), '')"
    query = lambda u: f"regexp_replace(regexp_replace(regexp_extract({u}, '{QUERY}', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '')"
    normal = lambda u: rf"case when contains({u}, '://') then regexp_replace({host(u)}, '^www\.|:(80|443)$', '', 'g') || regexp_replace({path(u)}, '/+$', '') || case when {query(u)} <> '' then '?' || {query(u)} else '' end end"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    attr = lambda name: "trim(" + " || ".join(f"regexp_extract(tag, '{ATTRIBUTE.format(name)}', {i})" for i in (1, 2, 3)) + ")"
    origin = f"regexp_extract(url, '{ORIGIN}', 1)"
    head, folder = "regexp_extract(link, '(?s)^([^?#]*)', 1)", f"regexp_extract({path('url')}, '(?s)^(.*/)', 1)"
    return f"""
with recursive rules(verdict, rule_host, rule_path) as (values {rules}),
tags as (select distinct url, unnest(regexp_extract_all(html, '{TAG}')) as tag from pages where contains(url, '://')),
named as (select url, regexp_replace(case when lower(tag[2:5]) = 'link' then case when contains(' ' || lower(regexp_replace({attr("rel")}, '\\s+', ' ', 'g')) || ' ', ' canonical ') then {attr("href")} end
    when lower({attr("http-equiv")}) = 'refresh' then trim(regexp_extract({attr("content")}, '{REFRESH}', 1)) end, '(?i)&amp;', '&', 'g') as link from tags),
split as (select distinct url, link, case when link is null or link = '' or starts_with(link, '#') then null
    when starts_with(link, '?') then {origin} || {path("url")} || link
    when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || link
    when regexp_matches(link, '{SCHEME}') then case when contains(link, '://') then link end end as whole,
  case when starts_with(link, '/') then {head} when {folder} = '' then '/' || {head} else {folder} || {head} end as joined from named),
dotted as (select *, whole is null and link <> '' and not starts_with(link, '#') and not regexp_matches(link, '{SCHEME}') as relative,
  case when regexp_matches(joined, '(^|/)[.]{{1,2}}$') then joined || '/' else joined end as ended from split),
undotted(url, link, whole, relative, left_, done) as (
  select url, link, whole, relative, case when regexp_matches(joined, '/[.]{{1,2}}(/|$)') then str_split(ended, '/')[2:] else str_split(joined, '/')[2:] end, ['']::varchar[] from dotted
  union all select url, link, whole, relative, left_[2:], case left_[1] when '.' then done when '..' then done[1:greatest(len(done) - 1, 1)] else list_append(done, left_[1]) end
  from undotted where len(left_) > 0),
targets as (select distinct url, case when relative then {origin} || array_to_string(done, '/') || substr(link, length({head}) + 1) else whole end as target from undotted where len(left_) = 0),
edges as (select {normal("url")} as a, {normal("target")} as b from targets where target is not null),
urls as (select url, {host("url")} as host, {path("url")} as path, {normal("url")} as node from (select url from pages where url is not null union select target from targets where target is not null)),
fits as (select url, rule_host || rule_path as rule, verdict, row_number() over (partition by url order by length(rule_host || rule_path) desc, length(rule_host) desc) as n
  from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
pairs as (select a, b from edges where a is not null and b is not null union select b, a from edges where a is not null and b is not null),
reach(a, b) as (select node, node from urls where node is not null union select r.a, e.b from reach r join pairs e on r.b = e.a),
parts as (select a as node, min(b) as part from reach group by a),
marked as (select u.url, u.host, u.path, f.rule, f.verdict, p.part from urls u left join fits f on f.url = u.url and f.n = 1 left join parts p on p.node = u.node),
marks as (select part, bool_or(verdict = 'block') and not bool_or(verdict = 'allow') as blocked from marked where verdict is not null and part is not null group by part)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(verdict, case when blocked then 'block' else 'allow' end) as verdict
from pages left join marked using (url) left join marks using (part)"""
