"""Registered queries on the given tables against plain Python, where they have no SQL and no test of their own."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from merchlife.llm import langid, queries
from merchlife.llm.storage import Workspace
from tests.llm.test_group_operators import brute_classes

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


def test_every_query_has_sql_or_a_test():
    tested = {"op1_permutation_index", "op2_token_records", "op3_label_propagation", "op6_dart_minhash", "op7_merge_dropout", "op8_language_id"}
    elsewhere = {"op9_token_rollup", "op12_merge_automaton"}
    assert set(queries.QUERIES) == set(queries.ORACLES) | tested | elsewhere


def test_op1_recall_and_scores(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{MORE}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids])
    found = defaultdict(dict)
    for r in queries.op1_permutation_index(spark, MORE).collect():
        assert r["score"] == pytest.approx(np.sqrt(((vectors[r["query_id"]] - vectors[r["vec_id"]]) ** 2).sum()), abs=1e-12)
        found[r["query_id"]][r["rank"]] = r["vec_id"]
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(found) == asked
    hit = 0
    for q in asked:
        far = np.sqrt(((table - vectors[q]) ** 2).sum(1))
        near = [int(ids[i]) for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        hit += len(set(near) & set(found[q].values()))
    assert hit >= 0.9 * 10 * len(asked)


def test_op2_is_the_librarys(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in queries.op2_token_records(spark, SMALL).collect()) == want


def test_op3_is_even_and_keeps_equal_texts_together(spark):
    rows = spark.read.parquet(f"{MORE}/documents.parquet").collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    out = queries.op3_label_propagation(spark, MORE).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    at, slots = {}, defaultdict(list)
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        at[r["doc_id"]] = r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert set(at.values()) <= set(range(40))
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(list)
    for i, t in text.items():
        if t is not None:
            groups[t].append(i)
    groups = [g for g in groups.values() if len(g) > 1]
    apart = sum(len(g) - max(Counter(at[i] for i in g).values()) for g in groups)  # links that the cut takes
    assert apart <= 0.02 * sum(map(len, groups))


def test_op6_classes_are_those_of_all_pairs(spark, docs):
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs])
    least = {i: min(docs[j]["doc_id"] for j, root in want.items() if root == want[i]) for i in want}
    out = {r["doc_id"]: r for r in queries.op6_dart_minhash(spark, SMALL).collect()}
    assert {i: r["class_id"] for i, r in out.items()} == {docs[i]["doc_id"]: c for i, c in least.items()}
    assert Counter(r["class_id"] for r in out.values() if r["keep"]) == Counter(set(least.values()))


def test_op7_decodes_to_the_texts(spark, docs):
    out = queries.op7_merge_dropout(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in out) == [r["doc_id"] for r in docs]
    assert all(r["lossless"] and (r["ids"] is None or r["n_pieces"] == len(r["ids"])) for r in out)


def test_op8_counts_are_those_of_plain_loops(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    filters = langid.learn(Workspace(spark, "test"), table.where(~langid.held_out()), slots=1 << 14)  # small, so that chance matches count
    texts = [r["text"] for r in docs[:60]]
    names, scores = langid.judge(filters, pa.array(texts, pa.string()))
    bits = [[bool(int(filters.table[0][slot]) >> i & 1) for i in range(len(filters.languages))] for slot in range(1 << 14)]
    chance = [(sum(b[i] for b in bits) / len(bits)) ** 3 for i in range(len(filters.languages))]
    for text, name, score in zip(texts, names, scores, strict=True):
        codes, _, lettered = langid.grams(pa.array([text], pa.string()))
        if not lettered[0]:
            assert (name, score) == ("und", 0.0)
            continue
        slots = [[int(s[j]) for s in langid.slots_of(codes, 1 << 14)] for j in range(len(codes))]
        counts = [sum(all(bits[s][i] for s in three) for three in slots) for i in range(len(filters.languages))]
        fair = [max(0, (c - len(codes) * x) / (1 - x)) for c, x in zip(counts, chance, strict=True)]
        assert name == filters.languages[int(np.argmax(fair))] and score == pytest.approx(min(1, max(fair) / len(codes)))
