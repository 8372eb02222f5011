"""Delta-maintained totals against a plain dictionary, races between jobs, and the query against plain Python."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from merchlife.llm import queries, rollups


@pytest.fixture
def batch(spark):
    return lambda *rows: spark.createDataFrame(list(rows), rollups.EVENT)


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_totals_follow_events(spark, batch, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/totals")
    assert totals(rollup) == {}
    first = batch((1, "v1", "insert", "a", "en", 10, 0), (2, "v1", "insert", "a", "en", 5, 0), (3, "v1", "insert", None, None, None, 0), (None, "v1", "insert", "b", "en", 2, 0), (2, "v1", "insert", "a", "en", 7, 1))
    assert rollup.commit("one", first)
    assert not rollup.commit("one", first)
    assert totals(rollup) == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 0), ("b", "en", "v1"): (1, 2)}
    assert rollup.commit("two", batch((1, "v1", "delete", "a", "en", None, 0), (9, "v1", "delete", "a", "en", None, 0), (2, "v1", "revise", "c", "fr", 8, 0), (2, "v2", "insert", "c", "fr", 6, 0)))
    want = {("c", "fr", "v1"): (1, 8), ("c", "fr", "v2"): (1, 6), (None, None, "v1"): (1, 0), ("b", "en", "v1"): (1, 2)}
    assert totals(rollup) == want
    first.write.parquet(f"file://{tmp_path}/totals/batches/died-1/signed")  # a try without an entry in the log
    assert totals(rollup) == want and rollup.commit("none", first.limit(0)) and totals(rollup) == want
    assert rollup.commit("nobody", batch((None, "v1", "delete", None, None, None, 0))) and ("b", "en", "v1") not in totals(rollup)
    with pytest.raises(ValueError):
        rollup.commit("../x", first)


def replay(ledger, rows):
    last = {}
    for doc, version, kind, source, lang, n, at in rows:
        best = last.get((doc, version))
        if best is None or (at, n if n is not None else -1) > (best[0], best[1] if best[1] is not None else -1):
            last[doc, version] = (at, n, kind, source, lang)
    for key, (_, n, kind, source, lang) in last.items():
        ledger.pop(key, None)
        if kind != "delete":
            ledger[key] = (source, lang, n or 0)


def test_random_batches_and_snapshots(spark, batch, tmp_path):
    rng = random.Random(6)
    rollup, ledger = rollups.Rollup(spark, f"file://{tmp_path}/totals", buckets=4, compact=3), {}
    for i in range(8):
        rows, seen = [], set()
        for _ in range(25):
            doc, version, at = rng.randrange(30), rng.choice(["v1", "v2"]), rng.randrange(50)
            if (doc, version, at) not in seen:
                seen.add((doc, version, at))
                kind = rng.choice(["insert", "delete", "revise"])
                rows.append((doc, version, kind, rng.choice(["a", "b", None]), rng.choice(["en", None]), None if kind == "delete" else rng.randrange(99), at))
        assert rollup.commit(f"b{i}", batch(*rows))
        assert not rollup.commit(f"b{i}", batch(*rows)) and not rollup.commit("b0", batch(*rows))
        replay(ledger, rows)
        want: dict = {}
        for (_, version), (source, lang, n) in ledger.items():
            docs, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (docs + 1, tokens + n)
        assert totals(rollup) == want
    _, snapshot, after = rollup._state()
    assert snapshot is not None and len(after) <= 3


def test_job_that_is_overtaken_with_the_same_batch(spark, batch, tmp_path):
    folder = f"file://{tmp_path}/totals"
    slow, fast = rollups.Rollup(spark, folder), rollups.Rollup(spark, folder)
    rows = batch((1, "v1", "insert", "a", "en", 10, 0))
    ready, told = slow._append, []

    def overtaken(number, entry):
        if not told:
            told.append(fast.commit("b1", rows))
        return ready(number, entry)

    slow._append = overtaken
    assert slow.commit("b1", rows) is False and told == [True]
    assert totals(slow) == {("a", "en", "v1"): (1, 10)}


def test_job_that_is_overtaken_by_another_batch(spark, batch, tmp_path):
    folder = f"file://{tmp_path}/totals"
    slow, fast = rollups.Rollup(spark, folder), rollups.Rollup(spark, folder)
    assert fast.commit("b0", batch((1, "v1", "insert", "a", "en", 10, 0)))
    ready, told = slow._append, []

    def overtaken(number, entry):
        if not told:
            told.append(fast.commit("b1", batch((1, "v1", "revise", "a", "en", 4, 0))))
        return ready(number, entry)

    slow._append = overtaken
    assert slow.commit("b2", batch((1, "v1", "delete", "a", "en", None, 0))) and told == [True]
    assert totals(slow) == {}


def test_job_that_dies_before_its_entry(spark, batch, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/totals")
    rows = batch((1, "v1", "insert", "a", "en", 10, 0))
    append = rollup._append
    rollup._append = lambda *x: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        rollup.commit("b1", rows)
    rollup._append = append
    assert totals(rollup) == {} and rollup.commit("b1", rows) and totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_lookups_read_the_asked_buckets_only(spark, batch, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/totals")
    rollup.commit("load", batch(*((i, "v1", "insert", "a", "en", i, 0) for i in range(200))))
    _, snapshot, batches = rollup._state()
    last = batch((7, "v1", "delete", "a", "en", None, 0)).withColumn("bucket", rollups.bucket_of("doc_id", 16))
    signed = rollup._signed(last, snapshot, batches)
    assert [tuple(r)[:6] for r in signed.collect()] == [(7, "v1", "a", "en", -1, -7)]
    files = spark.read.parquet(*(f"file://{tmp_path}/totals/{e['folder']}/signed" for e in batches))
    assert len(signed.inputFiles()) <= len(files.inputFiles())
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_query_is_that_of_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in queries.op9_token_rollup(spark, folder).collect()}
    coders = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, first = spark.read.parquet(f"{folder}/documents.parquet").collect(), {}
    for r in docs:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    n, tokens = Counter(), Counter()
    for r in docs:
        if r["text"] is not None and first[r["text"]] != r["doc_id"]:
            continue
        text = re.sub(r"[ \t\r\n]+", " ", r["text"] or "").strip(" ")
        version = "byte_bpe_50k" if r["lang"] == "en" else "byte_bpe_multi_50k"
        key = (r["source"], r["lang"], version)
        n[key] += 1
        tokens[key] += len(coders[version].encode_ordinary(text))
    assert got == {k: (n[k], tokens[k]) for k in n}
