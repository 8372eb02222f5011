"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, components.

Elements are shingles of five words (words: runs between ASCII white space), weighted by how often
a document has them; similarity is the weighted Jaccard of two documents, the sum of minima over
the sum of maxima. Each element owns the region weight x rank; darts fall on it at unit density,
placed by hashes of the element alone, so two documents see the same darts where both cover them.
A dart lands on one of ``k`` coordinates; each coordinate keeps the rank of its earliest dart below
the document's weight. Ranks are the signature: equal with the probability of the similarity.

Equal texts are one node. Bands of the signature put nodes into buckets. In each bucket every node
is compared with the one that meets most others (a star, so a bucket of n gives n pairs); nodes of a bucket that
are not yet in one component are then compared across components, in blocks of bounded size. Only
pairs whose exact similarity reaches the threshold link. A class is a component of links.

Defined cases. Null text: alone in its class. Texts without words: alike only if equal. Fewer than
five words: the whole text is one shingle. Null doc_id: belongs to its class, never names it unless
it is the only one. Repeated rows are copies. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.llm.bytescan import U64, mix, pieces, release, runs, span_hashes, texts, unit
from merchlife.llm.components import connected_components
from merchlife.llm.storage import Workspace, keyed, row_key, small, without

THROWN = 1 << 17  # darts thrown together
SOME = 256  # pairs whose bags are looked at together
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    block: int = 512  # nodes of a bucket compared with each other in one group
    few: int = 16  # buckets up to this size are compared by a plain join
    doubtful: float = 0.14  # pairs whose share of equal coordinates is so far below the similarity (3.5 deviations) are not verified

    fine: int = 1024  # coordinates, a byte each, of nodes that are compared across components
    close: float = 0.045  # their pairs' bound below the similarity, 3.5 deviations again

    @property
    def k(self) -> int:
        return self.bands * self.rows


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and shingle: text number (ascending), hash (ascending within a text), how often it occurs."""
    data, offsets = texts(column)
    start, end = runs(~_SPACE[data], offsets)
    hashes = span_hashes(data, start, end)
    owner = np.searchsorted(offsets, start, "right") - 1
    n = np.bincount(owner, minlength=len(column))
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(column)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    last = (first + n)[doc]
    joined = np.zeros(len(doc), U64)
    for i in range(words):
        here = at + i
        word = np.where(here < last, hashes[np.minimum(here, max(0, len(hashes) - 1))], U64(0)) if len(hashes) else np.zeros(len(doc), U64)
        joined = mix(joined * U64(0x9E3779B97F4A7C15) + word + U64(i + 1))
    order = np.lexsort((joined, doc))
    doc, joined = doc[order], joined[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (joined[1:] != joined[:-1])
    where = np.flatnonzero(new)
    return doc[where], joined[where], np.diff(np.append(where, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """docs x k ranks of the earliest darts; infinite for a document of no weight.

    The weight axis is cut into cells [2**v - 1, 2**(v+1) - 1). In a cell the darts come in order of
    rank, with exponential gaps: ranks are drawn until they pass the document's bound, which is set
    so that k coordinates are likely hit, and doubled for the documents with an empty coordinate.
    """
    sig = np.full((docs, k), np.inf)
    total = np.bincount(doc, weights=weight, minlength=docs)
    bound = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        pick = todo[doc]
        _throw(sig, doc[pick], element[pick], weight[pick], bound, k)
        todo = todo & np.isinf(sig).any(1)
        bound = bound * 2
    return sig


def _throw(sig, doc, element, weight, bound, k) -> None:
    flat = sig.reshape(-1)
    for level in range(int(np.log2(1 + weight.max())) + 1):
        low, width = 2.0**level - 1, 2.0**level
        on = weight > low
        d, w = doc[on], weight[on]
        key = mix(element[on] + U64(0xD1B54A32D192ED03 * (level + 1) % 2**64))
        rank = np.zeros(len(d))
        i, size = 0, 1
        while len(d):
            steps = np.arange(i, i + size, dtype=U64) * U64(0x9E3779B97F4A7C15)
            for low_row in range(0, len(d), max(1, THROWN // size)):
                rows = slice(low_row, low_row + max(1, THROWN // size))
                hit = mix(key[rows, None] + steps[None])
                gaps = -np.log(unit(hit)) / width
                gaps[:, 0] += rank[rows]
                ranks = np.cumsum(gaps, axis=1)
                rank[rows] = ranks[:, -1]
                more = mix(hit)
                inside = ranks < bound[d[rows]][:, None]
                if level or not np.all(w[rows] >= 1):
                    inside &= low + width * unit(mix(more)) < w[rows][:, None]
                r, _ = np.nonzero(inside)
                np.minimum.at(flat, d[rows][r] * k + (more[inside] % U64(k)).astype(np.int64), ranks[inside])
            stay = rank < bound[d]
            d, w, key, rank = d[stay], w[stay], key[stay], rank[stay]
            i, size = i + size, min(4 * size, 256)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """docs x bands bucket keys; a band's number is part of its key."""
    bits = sig.view(U64).reshape(len(sig), bands, sig.shape[1] // bands)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sig), bands)).copy()
    for i in range(bits.shape[2]):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return keys.view(np.int64)


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw, n = values.tobytes(), len(values)
    width = len(raw) // max(n, 1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def signed(texts_by_node: DataFrame, p: Params) -> DataFrame:
    """(node, sig, bands) from (node, text): sig has 32 bits of each coordinate, for estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            doc, element, weight = shingles(batch.column("text"), p.words)
            sig = signatures(doc, element, weight.astype(np.float64), len(batch), p.k)
            some = np.isfinite(sig).all(1)
            keys = band_keys(sig[some], p.bands)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, p.bands, dtype=np.int32), pa.array(keys.reshape(-1)))
            short = mix(sig[some].view(U64)).astype(np.uint32)
            yield pa.record_batch([batch.column("node").filter(pa.array(some)), _fixed(short), lists], names=["node", "sig", "bands"])

    return texts_by_node.select("node", "text").mapInArrow(run, "node binary, sig binary, bands array<long>")


def _bags(texts_by_node: DataFrame, p: Params) -> DataFrame:
    """(node, hashes, weights): sorted shingle hashes and their weights."""

    def run(batches):
        for batch in pieces(batches):
            doc, element, weight = shingles(batch.column("text"), p.words)
            cut = np.searchsorted(doc, np.arange(len(batch) + 1))
            e, w = element.tobytes(), weight.astype(np.uint32).tobytes()
            yield pa.record_batch([batch.column("node"), pa.array([e[8 * a : 8 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([w[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["node", "hashes", "weights"])

    return texts_by_node.select("node", "text").mapInArrow(run, "node binary, hashes binary, weights binary")


def jaccard(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    """Weighted Jaccard of two bags."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    u, v = np.frombuffer(wa, np.uint32).astype(np.int64), np.frombuffer(wb, np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    both = (y[at] == x) if len(y) else np.zeros(len(x), bool)
    same = int(np.minimum(u[both], v[at[both]]).sum())
    return same / max(1, int(u.sum() + v.sum()) - same)


def verified(space: Workspace, pairs: DataFrame, docs: DataFrame, p: Params, tag: str) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity reaches the threshold, with it."""
    pairs = space.save(pairs, f"{tag}-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = docs.join(small(space.save(asked, f"{tag}-asked"), 200_000), "node", "left_semi")
    bags = space.save(_bags(rows.dropDuplicates(["node"]), p), f"{tag}-bags")
    left = bags.select(F.col("node").alias("a"), F.col("hashes").alias("ah"), F.col("weights").alias("aw"))
    right = bags.select(F.col("node").alias("b"), F.col("hashes").alias("bh"), F.col("weights").alias("bw"))

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), SOME):
                part = batch.slice(low, SOME)
                cols = [part.column(c).to_pylist() for c in ("ah", "aw", "bh", "bw")]
                score = np.array([jaccard(*x) for x in zip(*cols, strict=True)])
                yield pa.record_batch([part.column("a"), part.column("b"), pa.array(score, pa.float64())], names=["a", "b", "similarity"]).filter(pa.array(score >= p.similarity - 1e-12, pa.bool_()))
        release()

    return space.save(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary, similarity double"), f"{tag}-links")


def _finely(texts_by_node: DataFrame, p: Params) -> DataFrame:
    """(node, sig): longer signatures, a byte for each coordinate."""

    def run(batches):
        for batch in pieces(batches):
            doc, element, weight = shingles(batch.column("text"), p.words)
            sig = signatures(doc, element, weight.astype(np.float64), len(batch), p.fine)
            yield pa.record_batch([batch.column("node"), _fixed(mix(sig.view(U64)).astype(np.uint8))], names=["node", "sig"])

    return texts_by_node.select("node", "text").mapInArrow(run, "node binary, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, least: float, kind: type) -> DataFrame:
    """Pairs whose signatures agree often enough to be worth an exact comparison."""
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(max(1, len(batch)), -1) for c in ("sa", "sb"))
            near = (x == y).mean(1) >= least if len(batch) else np.empty(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def _across(space: Workspace, buckets: DataFrame, docs: DataFrame, parts: DataFrame, p: Params) -> DataFrame:
    """Likely pairs of one bucket but different components: nodes outside a bucket's largest component against all its nodes.

    Both sides are cut into blocks of about ``p.block`` nodes; a group holds one block of each.
    """
    placed = buckets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    kinds = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max_by("component", F.struct("n", "component")).alias("main"))
    kinds = space.save(kinds.where("parts > 1").select("bucket", "main", F.when(F.col("all") <= p.few, 0).otherwise(F.ceil(F.col("all") / p.block)).cast("int").alias("blocks")), "split-buckets")
    rows = space.save(placed.join(kinds, "bucket"), "split-rows")
    asked = small(space.save(rows.select("node").distinct(), "split-nodes"), 200_000)
    sigs = space.save(_finely(docs.join(asked, "node", "left_semi").dropDuplicates(["node"]), p), "fine-signatures")
    least = p.similarity - p.close
    one = rows.where("blocks = 0")
    rest = one.where("component <> main").select("bucket", F.col("node").alias("x"), F.col("component").alias("cx"))
    pairs = rest.join(one.select("bucket", F.col("node").alias("y"), F.col("component").alias("cy")), "bucket").where("cx <> cy")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    many = rows.where("blocks > 0").join(sigs, "node").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), "blocks").cast("int"))
    grid = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = many.where("component <> main").select("bucket", F.col("own").alias("i"), grid.alias("j"), F.lit(True).alias("rest"), "node", "component", "sig")
    sides = sides.union(many.select("bucket", grid.alias("i"), F.col("own").alias("j"), F.lit(False).alias("rest"), "node", "component", "sig"))

    def run(table: pa.Table) -> pa.Table:
        outer, inner = table.filter(table["rest"]), table.filter(pa.compute.invert(table["rest"]))
        found: tuple[list, list] = ([], [])
        if len(outer) and len(inner):
            y = np.frombuffer(b"".join(inner["sig"].to_pylist()), np.uint8).reshape(len(inner), -1)
            names, parts_of = inner["node"].to_pylist(), inner["component"].to_pylist()
            for node, part, sig in zip(outer["node"].to_pylist(), outer["component"].to_pylist(), outer["sig"].to_pylist(), strict=True):
                for at in np.flatnonzero((y == np.frombuffer(sig, np.uint8)).mean(1) >= least):
                    if parts_of[at] != part:
                        found[0].append(min(node, names[at]))
                        found[1].append(max(node, names[at]))
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    blocks = sides.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary").distinct()
    return _likely(pairs, sigs, least, np.uint8).union(blocks).distinct()


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, key, class_id, keep) for each row of ``docs(doc_id, text)``.

    class_id: least doc_id of the class. keep: this row is the one that stays of its class.
    """
    space = Workspace(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text").withColumn("node", F.unhex(F.md5("text")))
    rows = space.save(docs.select("doc_id", "node", row_key().alias("key")), "rows")
    signs = space.save(signed(docs.where("node is not null"), p).dropDuplicates(["node"]), "signatures")
    sigs = signs.select("node", "sig")
    buckets = signs.select("node", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = space.save(buckets.join(sizes, "bucket"), "shared-buckets")
    # The node that meets most others is the likeliest centre of a group of copies.
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    ranks = space.save(shared.join(met, "node").select("bucket", "node", "met"), "met")
    heads = ranks.groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("head"))
    buckets = space.save(ranks.select("bucket", "node").join(heads, "bucket"), "buckets")
    stars = buckets.where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    links = verified(space, _likely(stars, sigs, p.similarity - p.doubtful, np.uint32), docs, p, "star").select("a", "b")
    parts = space.save(connected_components(space, links, "star-parts"), "star-components")
    more = verified(space, _across(space, buckets.select("bucket", "node"), docs, parts, p), docs, p, "rest").select("a", "b")
    parts = space.save(connected_components(space, links.union(more), "parts"), "components")
    grouped = rows.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    names = grouped.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    # Written, so that the join shuffles for itself and adaptive execution can split a large class.
    names = space.save(names, "names")
    out = grouped.join(names, "part", "left")
    return out.select(
        "doc_id",
        "key",
        F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("part").isNull() | ((F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))).alias("keep"),
    )


def deduplicate(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one row of each class; rows without text stay."""
    space = Workspace(docs.sparkSession, "dedup")
    found = space.save(classes(docs, p), "classes")
    left = without(docs, space.save(found.where("not keep").select("key"), "gone"))
    twice = space.save(found.where("keep").groupBy("key").count().where("count > 1").select("key"), "repeated")
    if twice.isEmpty():
        return left
    rows = keyed(left)
    again = rows.join(small(twice, 1_000_000), "key", "left_semi")
    once = again.where("row.text is not null").dropDuplicates(["key"]).union(again.where("row.text is null"))
    return rows.join(small(twice, 1_000_000), "key", "left_anti").union(once).select("row.*")
