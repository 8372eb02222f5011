"""Centroid clustering of whole-number vectors by bit planes.

Components are scaled and floored to whole numbers. Bit b of all 64 components of a vector, in two's
complement, is one 64-bit word: its plane b. With plane weights 1, 2, 4, … and a negative one for the
sign, the dot product of two vectors is the sum over pairs of planes of the weights' product times the
popcount of their AND; squared distances follow from it and the norms, which are dot products too. All
of it is exact in 64 bits: components up to 2**26 are allowed, larger ones are an error.

The planes are written once to the shared folder; each round reads them, and returns a count and a sum
of components for each cluster and task, which Spark adds up. Only the centroids are on the driver.

Defined cases. Null vectors, those of another length and those with a null or non-finite component take
no part and have no row. A vector without id is clustered but starts no centroid. Repeated rows are
vectors of their own; of equal ids the smaller vector comes first at the start. Fewer vectors than
centroids: fewer centroids. Ties: the smaller centroid number. No vectors: no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.llm.storage import Workspace

LANES = 64  # components of a vector, bits of a plane
LIMIT = 1 << 26
BLOCK = 4_096  # vectors compared with all centroids at once


@dataclass(frozen=True)
class Params:
    clusters: int = 40
    rounds: int = 5
    seed: str = "2"
    scale: int = 256


def whole(vectors: DataFrame, p: Params, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, as whole numbers."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = (F.size(x) == LANES) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    too_large = F.raise_error(F.lit(f"a scaled component is beyond {LIMIT}")).cast("long")
    scaled = F.transform(x, lambda c: F.when(F.abs(c * p.scale) <= LIMIT, F.floor(c * p.scale)).otherwise(too_large))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(ident).cast("long").alias("id"), scaled.alias("v"))


def weights(planes: int) -> np.ndarray:
    """1, 2, 4, …, and the sign's negative weight."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def pack(v: np.ndarray, planes: int) -> np.ndarray:
    """vectors x planes words of the bits of ``v`` (vectors x 64)."""
    bits = ((v[:, None, :] >> np.arange(planes)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack(x: np.ndarray) -> np.ndarray:
    """The components again."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8), axis=2, bitorder="little")
    return np.einsum("nbl,b->nl", bits, weights(x.shape[1]))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``x`` with all rows of ``y``, both packed."""
    w = weights(x.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    for i in range(x.shape[1]):
        part = np.zeros_like(out)
        for j in range(x.shape[1]):
            part += w[j] * np.bitwise_count(x[:, i, None] & y[None, :, j])
        out += w[i] * part
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Each row's dot product with itself."""
    w = weights(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for i in range(x.shape[1]):
        for j in range(x.shape[1]):
            out += w[i] * w[j] * np.bitwise_count(x[:, i] & x[:, j])
    return out


def nearest(x: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest packed centroid of each row, and the squared distance."""
    far = norm[:, None] - 2 * dots(x, centroids) + norms(centroids)[None]
    cluster = far.argmin(1)  # the first of equals
    return cluster, far[np.arange(len(x)), cluster]


def _blocks(batches: Iterator[pa.RecordBatch], planes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for low in range(0, len(batch), BLOCK):
            some = batch.slice(low, BLOCK)
            x = np.frombuffer(b"".join(some.column("planes").to_pylist()), "<u8").reshape(-1, planes)
            yield some, x, np.asarray(some.column("norm"))


def packed(vectors: DataFrame, planes: int) -> DataFrame:
    """(id, planes, norm) of ``vectors(id, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pack(np.asarray(pa.compute.list_flatten(batch.column("v"))).reshape(-1, LANES), planes)
            yield pa.record_batch([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norms(x))], names=["id", "planes", "norm"])

    return vectors.mapInArrow(run, "id long, planes binary, norm long")


def sums(table: DataFrame, planes: int, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each non-empty cluster: a row for each cluster, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), LANES), np.int64)
        for _, x, norm in _blocks(batches, planes):
            cluster, _ = nearest(x, norm, centroids)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(unpack(x)[order], first, axis=0)
            count += np.bincount(cluster, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    spread = parts.select("cluster", "n", F.posexplode("total").alias("lane", "part"))
    added = spread.groupBy("cluster", "lane").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()  # clusters x 64 numbers
    out = {r["cluster"]: (r["n"], [0] * LANES) for r in added}
    for r in added:
        out[r["cluster"]][1][r["lane"]] = r["total"]
    return out


def cluster(vectors: DataFrame, p: Params = Params(), ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = vectors.sparkSession
    space = Workspace(spark, "bitplanes")
    rows = whole(vectors, p, ident, column)
    edge = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, high = (edge["low"] or 0), (edge["high"] or 0)
    planes = 1 + max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0)
    table = space.save(packed(rows, planes), "planes")
    named = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("id").cast("string")), 256)
    start = rows.where("id is not null").orderBy(named, "v").limit(p.clusters).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, LANES)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(p.rounds):
        for i, (n, total) in sums(table, planes, pack(centroids, planes)).items():
            centroids[i] = [t // n for t in total]
    last = pack(centroids, planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x, norm in _blocks(batches, planes):
            number, far = nearest(x, norm, last)
            yield pa.record_batch([some.column("id"), pa.array(number.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    placed = space.save(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a number for each cluster
    told = [(i, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in inertia.items()]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(named), "cluster")  # a row for each cluster
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(p: Params = Params()) -> str:
    """DuckDB SQL for ``cluster`` over embeddings."""
    steps = [
        f"""kept as materialized (select row_number() over () as row_no, vec_id, [floor({p.scale} * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) = {LANES} and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0)""",
        f"""c0 as materialized (select place - 1 as cluster, v from (select v, row_number() over (order by sha256('{p.seed}:' || vec_id), v) as place from kept where vec_id is not null) where place <= {p.clusters})""",
    ]
    for r in range(1, p.rounds + 2):
        steps.append(f"""far{r} as materialized (select row_no, c.cluster, list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) for i in range(1, {LANES + 1})])::bigint as d from kept k, c{r - 1} c)""")
        steps.append(f"""a{r} as materialized (select row_no, cluster, d from (select *, row_number() over (partition by row_no order by d, cluster) as n from far{r}) where n = 1)""")
        if r <= p.rounds:
            steps.append(f"""m{r} as materialized (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from (
  select cluster, i, sum(x)::hugeint as s, count(*)::hugeint as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{r} join kept using (row_no)) group by cluster, i) group by cluster)""")
            steps.append(f"""c{r} as materialized (select cluster, coalesce(m{r}.v, c{r - 1}.v) as v from c{r - 1} left join m{r} using (cluster))""")
    last = p.rounds + 1
    return f"""
with {", ".join(steps)}
select vec_id, a.cluster::integer as cluster, d as distance, (sum(d) over (partition by a.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{last} a join kept using (row_no) join c{p.rounds} c on c.cluster = a.cluster"""
