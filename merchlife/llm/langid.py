"""Language identification with bit-sliced Bloom filters of byte n-grams.

One filter table serves all languages: slot i holds a bit mask of the languages that put an
n-gram there, so the AND of an n-gram's slots names every language that contains it. A language
contains an n-gram if the n-gram is about as frequent there as in the language where it is most
frequent. For each text the masks' bits are counted by language, the count that chance matches
of the filter would give is taken off, and the largest remainder decides.

Defined cases. Null text, or one without a letter: ``und``, score 0. Nothing learned: ``und``.
A text with a letter but without a known n-gram: the language with most training n-grams, score 0.
Ties: the language name that sorts first. Rows without text or lang are not learned from. Repeated
rows each get their result. Columns other than the three named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.llm.bytescan import U64, mix, pieces, texts
from merchlife.llm.storage import Workspace, row_key, without

UND = "und"
BITS = 60  # languages in one mask
GRAM = 4  # bytes
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], U64)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Filters:
    """``table[w, slot]``: masks of languages 60 w and on; its size is fixed by ``slots``, not by the corpus."""

    languages: tuple[str, ...]
    usual: int  # index of the language with most training n-grams
    table: np.ndarray

    def fill(self) -> np.ndarray:
        """Share of n-grams of no language that would match each language by chance."""
        share = [np.count_nonzero(self.table[i // BITS] >> U64(i % BITS) & U64(1)) / self.table.shape[1] for i in range(len(self.languages))]
        return np.array(share) ** len(_SEEDS)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the byte n-grams of folded texts, the text of each, and whether a text has an ASCII letter.

    Letters are lower-cased, all else in ASCII becomes one space, and texts start and end with a space.
    """
    data, offsets = texts(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    flat = np.full(len(data) + 2 * n, 32, np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths + 2)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, lengths)
    flat[place] = _FOLD[data]
    accented = np.zeros(len(flat), bool)
    accented[1:] = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)
    flat[accented] += 0x20
    lettered = np.bincount(owner[(flat >= 97) & (flat <= 122)], minlength=n) > 0
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    if len(flat) < GRAM:
        return np.empty(0, np.uint32), np.empty(0, np.int32), lettered
    codes = np.zeros(len(flat) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        codes |= flat[i : len(flat) - GRAM + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    whole = owner[GRAM - 1 :] == owner[: len(codes)]
    return codes[whole], owner[: len(codes)][whole], lettered


def slots_of(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    return [(mix(codes.astype(U64) + seed) % U64(slots)).astype(np.int64) for seed in _SEEDS]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        codes, owner, _ = grams(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        name = np.asarray(langs.indices)[owner]
        keys, n = np.unique(name.astype(np.int64) << 32 | codes.astype(np.int64), return_counts=True)
        yield pa.record_batch({"lang": langs.dictionary.take(pa.array(keys >> 32)), "gram": keys & 0xFFFFFFFF, "n": n.astype(np.int64)})


def learn(space: Workspace, rows: DataFrame, sample: int = 20_000, slots: int = 1 << 19, close: float = 0.3, least: int = 2, labels: int = 960) -> Filters:
    """Filters from ``rows(doc_id, text, lang)``.

    ``sample``: about so many labelled rows are learned from, the ones whose id hashes lowest;
    each of them whole. ``close``: an n-gram belongs to a language if its share of n-grams there is
    at least so many times its largest share. ``least``: and if seen so often there. ``labels``: more
    languages than that are an error; the filters take 4 MB for each 60 of them.
    """
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    counts = space.save(rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(labels + 1).collect()}
    if len(sizes) > labels:
        raise ValueError(f"lang has more than {labels} values")
    names = tuple(sorted(sizes))
    words = -(-len(names) // BITS)
    table = np.zeros((words, slots), U64)
    if not names:
        return Filters((), 0, table)
    lookup = counts.sparkSession.createDataFrame([(name, i, float(sizes[name])) for i, name in enumerate(names)], "lang string, language int, size double")
    shares = counts.where(F.col("n") >= least).join(F.broadcast(lookup), "lang").withColumn("share", F.col("n") / F.col("size"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    bits = shares.join(top, "gram").where(F.col("share") >= close * F.col("top"))
    masks = bits.groupBy("gram", F.floor(F.col("language") / BITS).cast("int").alias("word")).agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("language", F.lit(BITS)).cast("int"))).alias("mask"))

    def place(batches):
        for batch in batches:
            codes = np.asarray(batch.column("gram")).astype(np.uint32)
            for where in slots_of(codes, slots):
                yield pa.record_batch({"slot": where, "word": batch.column("word"), "mask": batch.column("mask")})

    placed = masks.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    found = placed.toArrow()  # at most words * slots rows, whatever the corpus
    table[np.asarray(found.column("word")), np.asarray(found.column("slot"))] = np.asarray(found.column("mask")).astype(U64)
    return Filters(names, max(range(len(names)), key=lambda i: (sizes[names[i]], -i)), table)


def judge(filters: Filters, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the corrected share of its n-grams that the language contains."""
    codes, owner, lettered = grams(column)
    n = len(column)
    for i in np.flatnonzero(~lettered):  # letters beyond ASCII
        lettered[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    if not filters.languages:
        return [UND] * n, np.zeros(n)
    where = slots_of(codes, filters.table.shape[1])
    counts = np.zeros((n, len(filters.languages)))
    for w in range(filters.table.shape[0]):
        mask = filters.table[w][where[0]]
        for x in where[1:]:
            mask &= filters.table[w][x]
        for byte in range(-(-min(BITS, len(filters.languages) - w * BITS) // 8)):
            part = (mask >> U64(8 * byte) & U64(255)).astype(np.int64)
            kinds = np.bincount(owner.astype(np.int64) * 256 + part, minlength=n * 256).reshape(n, 256)
            for bit in range(8):
                at = w * BITS + byte * 8 + bit
                if byte * 8 + bit < BITS and at < len(filters.languages):
                    counts[:, at] = kinds[:, np.arange(256) >> bit & 1 == 1].sum(1)
    total = np.bincount(owner, minlength=n)[:, None]
    chance = filters.fill()
    fair = np.maximum(0, (counts - total * chance) / np.maximum(1e-9, 1 - chance))
    best = np.where(fair.max(1) > 0, fair.argmax(1), filters.usual)
    score = np.clip(fair.max(1) / np.maximum(1, total[:, 0]), 0, 1)
    return [filters.languages[b] if ok else UND for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def identify(rows: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, key, lang_pred, score) for each row of ``rows(doc_id, text, key)``; key is passed on."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)  # fixed size

    def run(batches):
        for batch in pieces(batches):
            names, score = judge(shared.value, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "key", "lang_pred", "score"])

    kind = dict(rows.dtypes)
    return rows.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind['doc_id']}, key {kind['key']}, lang_pred string, score double")


def held_out() -> F.Column:
    """The contract's split: these rows are not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def predict_languages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from rows that are not held out, predict every row."""
    space = Workspace(docs.sparkSession, "langid")
    filters = learn(space, docs.where(~held_out()), **options)
    out = identify(docs.select("doc_id", "text", held_out().alias("key")), filters)
    return out.select("doc_id", F.col("key").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, score: float = 0.2, length: int = 20, **options) -> DataFrame:
    """``docs`` without rows of no language: ``und``, or ``length`` characters and more that score below ``score`` in all languages."""
    space = Workspace(docs.sparkSession, "langid")
    filters = learn(space, docs.where(~held_out()), **options)
    found = identify(docs.select("doc_id", "text", F.struct(row_key().alias("key"), F.length("text").alias("n")).alias("key")), filters)
    bad = (F.col("lang_pred") == UND) | ((F.col("score") < score) & (F.col("key.n") >= length))
    return without(docs, space.save(found.where(bad).select("key.key"), "rejected"))
