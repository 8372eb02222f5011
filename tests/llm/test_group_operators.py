"""Near-duplicates, components, sharding, vectors, rollups, URLs and the pipeline against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from merchlife.llm import neardup, permindex, sharding
from merchlife.llm.components import connected_components
from merchlife.llm.storage import Workspace


def unite(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(Workspace(spark, "test"), df).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == unite(nodes, [e for e in edges if e[0] != e[1]])


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            same, total = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if rows[i][1] == rows[j][1] or (total and same / total >= 0.8):
                links.append((i, j))
    return unite(range(len(rows)), links)


def near_copies():
    rng = random.Random(11)
    text = [f"w{rng.randrange(9999)}" for _ in range(150)]
    rows = [(0, " ".join(text))]
    for i in range(1, 40):  # a large group of near copies
        copy = list(text)
        copy[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    for i in range(40, 60):  # far copies, below the threshold
        copy = list(text)
        for _ in range(12):
            copy[rng.randrange(150)] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    return rows + [(60 + i, " ".join(f"z{rng.randrange(9999)}" for _ in range(80))) for i in range(10)] + [(80, rows[61 - 1][1] if len(rows) > 60 else rows[0][1])]


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicate_classes(documents, block):
    rows = near_copies()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(rows), neardup.Params(block=block)).collect()}
    want = brute_classes(rows)
    assert got == {rows[i][0]: rows[j][0] for i, j in want.items()}


def test_near_duplicates_of_awkward_rows(awkward, documents):
    rows = neardup.classes(awkward).collect()
    assert len(rows) == 10
    left = neardup.deduplicate(awkward)
    assert left.columns == awkward.columns
    assert Counter(r["text"] for r in left.collect()) == Counter({r["text"] for r in awkward.collect()})
    assert neardup.deduplicate(documents([])).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    a = {int(e): float(w) for e, w in zip(rng.integers(1, 2**60, 300), rng.integers(1, 9, 300), strict=True)}
    b = dict(a)
    for e in list(a)[:120]:
        b[e] = a[e] / 2
    want = sum(min(a[e], b[e]) for e in a) / sum(max(a[e], b[e]) for e in a)
    elements = np.array([*a, *b], np.uint64)
    weights = np.array([*a.values(), *b.values()])
    doc = np.repeat([0, 1], len(a))
    sig = neardup.signatures(doc, elements, weights, 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_shards_are_even_and_groups_whole(documents):
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"copy {i // 4}") for i in range(200)] + [(2000 + i, "hot") for i in range(300)]
    out = sharding.shard_documents(documents(rows), shards=9).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == 900 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    at = {r["doc_id"]: r["shard"] for r in out}
    whole = sum(len({at[1000 + 4 * g + i] for i in range(4)}) == 1 for g in range(50))
    assert whole >= 40  # by chance nearly none would be
    assert sum(sorted(Counter(at[2000 + i] for i in range(300)).values())[-4:]) >= 200


def test_shards_without_free_rows_swap(documents):
    rows = [(i, f"copy {i // 4}") for i in range(2000)]  # every row has a copy, so no shard has room
    out = sharding.shard_documents(documents(rows), shards=10).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {200}
    groups = defaultdict(set)
    for r in out:
        groups[r["doc_id"] // 4].add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 50


def test_admitted_moves_keep_quotas():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(2, 7)
        asked = {s * n + t: rng.randrange(1, 30) for s in range(n) for t in range(n) if s != t and rng.random() < 0.6}
        free = [rng.choice([0, 0, 3]) for _ in range(n)]
        let = sharding.admitted(asked, free)
        assert all(0 <= let[w] <= asked[w] for w in asked)
        for t in range(n):
            assert sum(k for w, k in let.items() if w % n == t) - sum(k for w, k in let.items() if w // n == t) <= free[t]
    assert sharding.admitted({1: 5, 2: 7}, [0, 0]) == {1: 5, 2: 5}
    assert sharding.admitted({1: 4, 5: 4, 6: 4}, [0, 0, 0]) == {1: 4, 5: 4, 6: 4}


def test_shards_of_awkward_rows(awkward, documents):
    out = sharding.shard_documents(awkward, shards=3).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [3, 3, 4]
    assert {r["size"] for r in out if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard_documents(documents([])).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12))
    x[5] = x[7] = x[300]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    odd = [(900, None), (901, [0.0] * 12), (902, [float("nan")] + [1.0] * 11), (903, [None] + [1.0] * 11), (904, [1.0]), (None, [1.0] * 12), (5, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v")
    out = permindex.search(df, df.where("vec_id % 100 = 0")).collect()
    hit = 0
    for q in range(0, 600, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(abs(r["score"] - far[r["vec_id"]]) < 1e-9 for r in got)
        hit += len(set(want) & {r["vec_id"] for r in got})
    assert hit >= 54
    assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 300), key=lambda r: r["rank"])][:2] == [5, 7]


def test_vector_search_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = permindex.search(few, few.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in out] == [(1, 0.0), (2, 1.414214)]
    assert permindex.search(few.limit(0), few.limit(0)).count() == 0


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(0)
    entries = np.array([rng.permutation(30)[:8] for _ in range(50)], np.int16)
    gain = permindex.footrule_gain(entries[:3], entries, 30, 8)
    for i in range(3):
        for j in range(50):
            a, b = entries[i].tolist(), entries[j].tolist()
            distance = sum(abs((a.index(p) if p in a else 8) - (b.index(p) if p in b else 8)) for p in {*a, *b})
            assert distance == 8 * 9 - 2 * gain[i, j]


def test_pipeline_stages(spark, documents, tmp_path):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = [(i, f"the quick brown fox number {i} jumps over the lazy dog again and again until evening {i * 7}", "en") for i in range(60)]
    docs = documents(base + [(100, base[0][1], "en"), (101, "before " + leak + " after", "en"), (102, "the quick brown fox jumps over token=abcdefgh1234 the lazy dog until evening", "en"), (103, None, "en"), (104, "12 34", "en")])
    space = Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, space.save(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {*range(60), 102}
    assert left[102] == "the quick brown fox jumps over [secret] the lazy dog until evening"
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == 61 and all(r["lossless"] for r in out)


def test_words_of_documents_group_by_text():
    """The brute force above sees what it should."""
    groups = defaultdict(list)
    for i, j in brute_classes([(0, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (3, None), (4, None)]).items():
        groups[j].append(i)
    assert sorted(map(len, groups.values())) == [1, 1, 1, 2]
