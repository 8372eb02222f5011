"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Index blocks of bounded size hold inverted
files: for each pivot, the vectors that have it among their first ``prefix`` and at which place. A
query reads the lists of its own pivots and adds up, for each vector it meets, prefix - max(place,
place); footrule distance with absent pivots at place ``prefix`` is prefix * (prefix + 1) minus
twice that sum. The vectors of least footrule distance, ``depth`` of a block and all that tie with
the last, are ranked by their true distance. Blocks of queries meet all blocks of the index.

Pivots come from a bounded sample (``sample`` vectors that hash lowest, spread by farthest point);
all vectors are indexed. Equal vectors are one entry of the index; each keeps its k + 1 smallest
ids, more cannot be in a result.

Defined cases. Null or empty vectors, zero vectors, and those with null, infinite or undefined
components take no part, nor do null ids, nor vectors of another length than the most frequent
(the shorter, if equally frequent). Of rows with one id the least vector counts. Repeated rows
count once. Other columns are not looked at. No vectors: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.llm.storage import Workspace


@dataclass(frozen=True)
class Params:
    k: int = 10
    pivots: int = 512
    prefix: int = 64
    depth: float = 0.1  # of a block's vectors
    least: int = 300
    sample: int = 8_192
    block: int = 8_192
    queries: int = 4_096


def usable(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(id, v): one row for each id that takes part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each next one the farthest of a few candidates from those chosen."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(sample))
    chosen = [order[0]]
    rest = order[1:]
    while len(chosen) < min(count, len(sample)):
        some, rest = rest[:4], rest[4:]
        if not len(some):
            break
        last = sample[chosen[-256:]]
        gap = ((sample[some][:, None] - last[None]) ** 2).sum(2).min(1)
        chosen.append(some[gap.argmax()])
    return sample[chosen]


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, in order; ties by pivot number."""
    far = (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def footrule_gain(query: np.ndarray, entries: np.ndarray, pivots: int, prefix: int) -> np.ndarray:
    """queries x entries: the sum over shared pivots of prefix - max(place, place), from inverted files."""
    n, width = entries.shape
    pivot, place, entry = entries.reshape(-1), np.tile(np.arange(width), n), np.repeat(np.arange(n), width)
    order = np.argsort(pivot, kind="stable")
    entry, place = entry[order], place[order]
    first = np.searchsorted(pivot[order], np.arange(pivots + 1))
    out = np.zeros((len(query), n))
    for i, row in enumerate(query):
        lists = [np.arange(first[p], first[p + 1]) for p in row]
        at = np.concatenate(lists)
        mine = np.repeat(np.arange(len(row)), [len(x) for x in lists])
        out[i] = np.bincount(entry[at], weights=prefix - np.maximum(place[at], mine), minlength=n)
    return out


def _block_search(p: Params, pivots: np.ndarray, table: pa.Table) -> pa.Table:
    asks = table.filter(table["query"])
    holds = table.filter(pa.compute.invert(table["query"]))
    found: tuple[list, list, list] = ([], [], [])
    if len(asks) and len(holds):
        width = pivots.shape[1]
        x = np.asarray(pa.compute.list_flatten(holds["v"])).reshape(-1, width)
        q = np.asarray(pa.compute.list_flatten(asks["v"])).reshape(-1, width)
        prefix = min(p.prefix, len(pivots))
        members = holds["ids"].to_pylist()
        ask_ids = asks["ids"].to_pylist()
        entries = prefixes(x, pivots, prefix)
        for low in range(0, len(q), 64):
            part = q[low : low + 64]
            gain = footrule_gain(prefixes(part, pivots, prefix), entries, len(pivots), prefix)
            depth = min(len(x), max(p.least, int(np.ceil(p.depth * len(x)))))
            for i in range(len(part)):
                edge = np.partition(gain[i], len(x) - depth)[len(x) - depth]
                near = np.flatnonzero(gain[i] >= edge)
                far = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
                me = ask_ids[low + i][0]
                pairs = []
                keep = np.sort(far)[min(len(far), p.k + 1) - 1]
                for at in np.flatnonzero(far <= keep):
                    pairs += [(far[at], other) for other in members[near[at]] if other != me]
                for score, other in sorted(pairs)[: p.k]:
                    found[0].append(me)
                    found[1].append(other)
                    found[2].append(float(score))
    return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})


def search(vectors: DataFrame, queries: DataFrame, p: Params = Params(), ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each of ``queries``, never the query's own id."""
    space = Workspace(vectors.sparkSession, "permindex")
    rows = space.save(usable(vectors, ident, column), "rows")
    numbered = F.row_number().over(_by("v", "id"))
    # Equal vectors: a row of the index, with the ids a result could hold. Only the first of each share of ids are gathered.
    firsts = rows.withColumn("n", numbered).where(F.col("n") <= p.k + 1)
    entries = space.save(firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    share = min(1.0, p.sample / max(1, n))
    sample = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * p.sample).toArrow()
    if not n or not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    matrix = np.array(sorted(sample["v"].to_pylist()))
    pivots = choose_pivots(matrix, min(p.pivots, max(1, len(matrix))))
    blocks = -(-n // p.block)
    asked = usable(queries, ident, column).select(F.array("id").alias("ids"), "v")
    asked = space.save(asked.withColumn("j", F.xxhash64("ids")), "asked")
    groups = -(-max(1, asked.count()) // p.queries)
    holds = entries.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("j"), F.lit(False).alias("query"), "ids", "v")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.pmod("j", F.lit(groups)).cast("int").alias("j"), F.lit(True).alias("query"), "ids", "v")
    near = holds.union(asks).groupBy("i", "j").applyInArrow(lambda t: _block_search(p, pivots, t), "query_id long, vec_id long, score double")
    rank = F.row_number().over(_by("query_id", "score", "vec_id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= p.k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by(group: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)
