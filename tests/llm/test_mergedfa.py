"""The tokenization automaton against the tokenizers library, and on small merge lists against plain merging."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from merchlife.llm import mergedfa, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "LL", "é", "ß", "1", "22", "½", "²", "!", "...", "<|", "<|endoftext|>", "日本", " ", " ", "😀", "z" * 60, "ing", "ñ", "Ā", "×", "\x1c", "\x00", "’", "\u0085"]


@pytest.fixture(scope="module")
def coder():
    return mergedfa.Coder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts_of(coder, column):
    ids, counts = coder.encode(pa.array(column, pa.string()))
    stops = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)]


def test_ids_are_the_librarys(coder, library):
    rng = random.Random(1)
    column = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(14))) for _ in range(5000)]
    column += ["".join(rng.choice("abcdefgh etaoinE'") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    column += [None, "", "a" * 500, "ab" * 300, " " * 90 + "x", "x" + "\n" * 70]
    want = [e.ids for e in library.encode_batch([t or "" for t in column], add_special_tokens=False)]
    assert texts_of(coder, column) == want


def merged(word, merges):
    parts = list(word)
    for u, v in merges:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (u, v):
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


@pytest.mark.parametrize("merges", [[("a", "a")], [("a", "a"), ("aa", "aa")], [("a", "b"), ("ab", "ab"), ("b", "b")], [("a", "a"), ("b", "aa"), ("aa", "a"), ("b", "b")]])
def test_small_merge_lists(tmp_path, merges):
    names = mergedfa.byte_letters() + [u + v for u, v in merges]
    spec = {"model": {"vocab": {n: i for i, n in enumerate(names)}, "merges": [list(m) for m in merges]}, "added_tokens": []}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    auto = mergedfa.MergeAutomaton(str(tmp_path / "t.json"))
    assert len(auto.owner) == len(merges) + 1  # a state for each gadget
    for n in range(1, 9):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            assert [names[i] for i in auto.run(word.encode())] == merged(word, merges)


def test_merges_out_of_order_are_refused(tmp_path):
    names = mergedfa.byte_letters() + ["ab", "abc"]
    spec = {"model": {"vocab": {n: i for i, n in enumerate(names)}, "merges": [["ab", "c"], ["a", "b"]]}, "added_tokens": []}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        mergedfa.MergeAutomaton(str(tmp_path / "t.json"))


def test_query_is_the_librarys(spark, library):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_merge_automaton(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), hexed(",".join(map(str, ids))), hexed(library.decode(ids, skip_special_tokens=False)))


def test_awkward_rows(awkward, documents):
    rows = awkward.selectExpr("*", "'clash' as IDS", "'row' as `row`", "1 as n_tokens")
    coded = mergedfa.encode(rows, PATH)
    assert [c.lower() for c in coded.columns] == [c.lower() for c in [*awkward.columns, "row", "ids", "n_tokens"]]
    back = mergedfa.decode(coded.withColumnRenamed("text", "was"), PATH).collect()
    assert len(back) == 10 and all(r["text"] == r["was"] for r in back)
    assert all((r["ids"] is None) == (r["was"] is None) for r in back)
    assert mergedfa.digests(awkward, PATH).where("n_tokens = 0").count() == 2
    assert mergedfa.digests(documents([]), PATH).count() == 0 and mergedfa.encode(documents([]), PATH).count() == 0
