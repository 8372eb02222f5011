"""Byte-level BPE by a tokenization automaton, and decoding.

The automaton reads token labels. It starts as one state with an arc back to itself for each byte.
The merges are then applied one after the other as gadgets: merge (u, v) sends all u arcs to a copy
of the state they led to, the copy has no v arc, and wherever a u arc leaves, an arc labelled uv is
added that leads where v led. What remains are the label sequences that the merges yield, and for any
bytes there is one of them. All arcs of a label lead to one state, and a copy differs from its
original in one arc, so the automaton is kept persistently: a state is the label whose copies made it,
the number of the last of these merges, and the state it was copied from; the arcs that copies lost
are one hash table (label, lost label) -> merge. A state has an arc labelled x unless it lost x, or
lost a left part of x before the merge that made the larger part.

Words are cut as the tokenizer file's pattern does. A word is encoded by following arcs from state 0:
the bytes at a place are spelled in a trie of labels, and of the labels that the state has arcs for the
longest is taken; where none leads on, the last one is given back for a shorter one. A place is reached
by one sequence of labels only, so none is entered twice and the time is in proportion to the length.
Decoding emits the bytes of the arc labels.

Defined cases. Null and empty texts have no ids. The strings of added tokens in a text become their
ids. Repeated rows each get their result. Columns besides the text are passed on by ``encode`` and
``decode``, whose result columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from merchlife.llm.bytescan import pieces, texts
from merchlife.llm.storage import replaced
from merchlife.llm.unitmemo import UnitMemo

ARCS = 200_000  # answers about arcs that a worker remembers
PART = 512 << 10  # bytes of text looked at together; new words are asked for at once


def byte_letters() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte_of = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * self.size
        for name, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in name)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.added.items():
            self.bytes_of[i] = name.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._compile([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
        self._spell(set(vocab.values()) - set(self.added.values()))
        self.length_of = [len(b) for b in self.bytes_of]
        self.longest = max(self.length_of)
        self.length = np.array(self.length_of, np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    # Compilation

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """The merge gadgets, one after the other. State 0 has all arcs."""
        self.born, self.left = [0] * self.size, [-1] * self.size
        self.target = [0] * self.size  # the state that arcs of a label lead to
        self.owner, self.upto, self.base = [-1], [0], [-1]
        self.lost: dict[int, int] = {}
        made: set[int] = set()
        for k, (u, v, uv) in enumerate(merges, 1):
            if uv in made or any(len(self.bytes_of[x]) > 1 and x not in made for x in (u, v)):
                raise ValueError("each merge has to make a new token of tokens made before")
            if not self.has_arc(self.target[u], v):
                raise ValueError(f"merge {k} can never apply")
            made.add(uv)
            self.born[uv], self.left[uv] = k, u
            self.target[uv] = self.target[v]
            copied = self.target[u]
            # Copies that one label's merges made follow each other: they share the state that the label began with.
            self.base.append(self.base[copied] if self.owner[copied] == u else copied)
            self.owner.append(u)
            self.upto.append(k)
            self.lost[u << 32 | v] = k
            self.target[u] = len(self.owner) - 1

    def has_arc(self, state: int, label: int) -> bool:
        while state > 0:
            owner, upto = self.owner[state], self.upto[state]
            part, until = label, upto
            while part >= 0:
                if 0 < self.lost.get(owner << 32 | part, 0) <= until:
                    return False
                until, part = min(upto, self.born[part]), self.left[part]
            state = self.base[state]
        return True

    def _spell(self, labels: set[int]) -> None:
        """The trie of the labels' bytes: byte -> (label that ends there or -1, the bytes that follow)."""
        self.whole = {self.bytes_of[label]: label for label in labels}
        self.trie: dict = {}
        for word in sorted(self.whole, key=len):
            node = self.trie
            for i, byte in enumerate(word, 1):
                if byte not in node:
                    node[byte] = (self.whole.get(word[:i], -1), {})
                node = node[byte][1]
        self.known: dict[int, bool] = {}

    # Encoding

    def run(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``."""
        if word in self.whole:  # state 0 has all arcs
            return [self.whole[word]]
        n, size, known = len(word), self.length_of, self.known
        path, before, tried = [], [], bytearray(n + 1)
        at, state, todo = 0, 0, None
        while True:
            if todo is None:  # the labels spelled from here, the longest last
                todo, node = [], self.trie
                for byte in word[at : at + self.longest]:
                    step = node.get(byte)
                    if step is None:
                        break
                    label, node = step
                    if label >= 0:
                        todo.append(label)
            while todo:
                label = todo.pop()
                end = at + size[label]
                if tried[end]:
                    continue
                arc = known.get(state << 32 | label)
                if arc is None:
                    if len(known) >= ARCS:
                        known.clear()
                    arc = known[state << 32 | label] = self.has_arc(state, label)
                if arc:
                    path.append(label)
                    if end == n:
                        return path
                    tried[end] = 1
                    before.append((at, state, todo))
                    at, state, todo = end, self.target[label], None
                    break
            else:
                path.pop()
                at, state, todo = before.pop()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, the labels of their arcs, and where each starts (one more entry than rows)."""
        n = self.length[ids]
        before = np.cumsum(n) - n
        data = self.all_bytes[np.arange(int(n.sum())) + np.repeat(self.first[ids] - before, n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return data, total[np.concatenate([[0], np.cumsum(counts)])]


# Words of the pattern, on bytes. Rows with other signs are cut by the library.
_BLANK, _GAP, _LETTER, _DIGIT, _OTHER, _BAD = range(6)
_CLASS = np.full(256, _BAD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13]] = _GAP
_CLASS[32] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _CLASS[65:91] = _LETTER
_PAIRS = {lead: np.full(256, _BAD, np.uint8) for lead in (0xC2, 0xC3, 0xC4, 0xC5)}
_PAIRS[0xC2][0xA1:0xC0] = _OTHER
_PAIRS[0xC2][[0xAA, 0xB5, 0xBA]] = _LETTER
_PAIRS[0xC2][[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
for _lead in (0xC3, 0xC4, 0xC5):
    _PAIRS[_lead][0x80:0xC0] = _LETTER
_PAIRS[0xC3][[0x97, 0xB7]] = _OTHER
_ENDINGS = {b"s": 1, b"t": 1, b"m": 1, b"d": 1, b"re": 2, b"ve": 2, b"ll": 2}  # after an apostrophe, as in the pattern


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    kind = _CLASS[data]
    follows = np.append(data[1:], 0)
    for lead, tail in _PAIRS.items():
        at = np.flatnonzero(data[:-1] == lead)
        kind[at] = kind[at + 1] = tail[follows[at]]
    return kind


def word_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte, and at the end, for texts without bad classes."""
    n = len(data)
    space = kind <= _GAP
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    cut = np.ones(n + 1, bool)
    before, now = kind[:-1], kind[1:]
    change = (before != now) & ~(space[:-1] & space[1:])
    cut[1:n] = row[1:n] | (change & ~(before == _BLANK))
    # Of several spaces before a word, the last one is cut off.
    last = space & ~row[1:]
    last[:-1] &= ~space[1:]
    inner = np.zeros(n, bool)
    inner[1:] = space[1:] & space[:-1] & ~row[1:n]
    last[-1] = False
    cut[:n][last & inner] = True
    quote = np.flatnonzero(data == 39)
    if len(quote):
        begins = row[quote] | (quote == 0)
        previous = kind[np.maximum(quote - 1, 0)]
        begins |= (previous == _LETTER) | (previous == _DIGIT) | (previous == _GAP)
        end = offsets[np.searchsorted(offsets, quote, "right")]
        one, two = (data[np.minimum(quote + i, n - 1)] for i in (1, 2))
        size = np.zeros(len(quote), np.int64)
        for letters, length in _ENDINGS.items():
            same = one == letters[0]
            if length == 2:
                same &= two == letters[1]
            size[same & begins & (quote + length < end)] = length
        for i in range(len(quote)):
            if size[i]:
                cut[quote[i] + 1 : quote[i] + 1 + size[i]] = False
                cut[quote[i] + 1 + size[i]] = True
    return cut


class Coder:
    """A compiled automaton with the words it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or spec["normalizer"] or spec["post_processor"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("the tokenizer file asks for steps that are not provided")
        self.automaton = MergeAutomaton(path)
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.special = {name.encode(): i for name, i in self.automaton.added.items()}
        self.memo = UnitMemo(lambda units, _: self._ids(units), limit=600_000)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        run, special = self.automaton.run, self.special
        found = [[special[w]] if w in special else run(w) for w in words]
        return np.array([x for ids in found for x in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def _cut_whole(self, text: str) -> list[int]:
        """Lengths in bytes of the words of one text, by the library's own pattern; added tokens are words."""
        parts = [(text, False)]
        for name in self.automaton.added:
            parts = [x for part, done in parts for x in ([(part, True)] if done else [(p, j % 2 == 1) for j, p in enumerate(_split(part, name))])]
        out = []
        for part, done in parts:
            if done:
                out.append(len(part.encode()))
            elif part:
                out += [len(w) for w, _ in self.cutter.pre_tokenize_str(part)]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; null is empty."""
        data, offsets = texts(column)
        n = len(column)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        kind = kinds(data)
        wrong = kind == _BAD
        for name in self.special:
            wrong[:-1] |= (data[:-1] == name[0]) & (data[1:] == name[min(1, len(name) - 1)])
        other = np.unique(np.searchsorted(offsets, np.flatnonzero(wrong), "right") - 1)
        cut = word_starts(data, offsets, kind)
        raw = data.tobytes() if len(other) else b""
        for i in other.tolist():
            low, high = int(offsets[i]), int(offsets[i + 1])
            cut[low:high] = False
            cut[low + np.cumsum([0, *self._cut_whole(raw[low:high].decode("utf-8"))])[:-1]] = True
        places = np.flatnonzero(cut)
        start, end = places[:-1], places[1:]
        ids, counts = self.memo.ids(data, start, end)
        rows = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(rows, weights=counts, minlength=n).astype(np.int64)


def _split(text: str, name: str) -> list[str]:
    """Text around and at each occurrence of ``name``, alternating."""
    parts = text.split(name)
    return [x for p in parts for x in (p, name)][:-1]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """Once for each worker."""
    return Coder(path)


def _lists(ids: np.ndarray, counts: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)), mask=None if none is None else pa.array(none))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(text, …)`` with ``ids`` (array of int; null for null text) and ``n_tokens``."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([row.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PART):
            ids, counts = coder(path).encode(batch.column("text"))
            lists = _lists(ids, counts, np.asarray(batch.column("text").is_null()))
            yield pa.record_batch([batch.column("row"), lists, pa.array(counts)], names=["row", "ids", "n_tokens"])

    return replaced(row.mapInArrow(run, schema), docs.columns, ids=F.col("ids"), n_tokens=F.col("n_tokens"))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text`` made from column ``ids``; null ids give null."""
    row = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(ids).cast("array<int>").alias("ids"))
    schema = T.StructType([row.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            counts = np.asarray(pa.compute.list_value_length(column).fill_null(0)).astype(np.int64)
            data, at = coder(path).automaton.decode(np.asarray(column.flatten()).astype(np.int64), counts)
            made = [None if null else data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i, null in enumerate(column.is_null().to_pylist())]
            yield pa.record_batch([batch.column("row"), pa.array(made, pa.string())], names=["row", "text"])

    return replaced(row.mapInArrow(run, schema), rows.columns, text=F.col("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs(doc_id, text)``: encoded, then decoded from the ids."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PART):
            one = coder(path)
            ids, counts = one.encode(batch.column("text"))
            data, at = one.automaton.decode(ids, counts)
            numbers, raw = ids.tolist(), data.tobytes()
            stops = np.concatenate([[0], np.cumsum(counts)]).tolist()
            written = [hashlib.sha256(",".join(map(str, numbers[a:b])).encode()).hexdigest() for a, b in zip(stops, stops[1:], strict=False)]
            told = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts), pa.array(written, pa.string()), pa.array(told, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
