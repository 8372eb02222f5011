"""Bit-plane clustering against plain integer arithmetic and against its SQL."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from merchlife.llm import bitplanes, queries
from verification.compare import difference, duckdb_on


@pytest.mark.parametrize("planes", [2, 9, 27])
def test_dots_norms_and_unpacking_are_exact(planes):
    rng = np.random.default_rng(planes)
    high = 1 << (planes - 1)
    x, y = (rng.integers(-high, high, (n, 64)) for n in (50, 7))
    x[0], x[1], y[0], y[1] = -high, high - 1, -high, high - 1
    a, b = bitplanes.pack(x, planes), bitplanes.pack(y, planes)
    assert a.dtype == np.uint64 and a.shape == (50, planes)
    assert (bitplanes.unpack(a) == x).all()
    assert (bitplanes.dots(a, b) == x @ y.T).all()
    assert (bitplanes.norms(a) == (x * x).sum(1)).all()
    cluster, far = bitplanes.nearest(a, bitplanes.norms(a), b)
    want = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (cluster == want.argmin(1)).all() and (far == want.min(1)).all()


def brute(rows, p):
    kept = [(i, [math.floor(p.scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[: p.clusters]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(p.rounds):
        at = [assign(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    placed = [(i, *assign(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, a in placed if a == k) for k in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in placed), key=repr)


def test_clusters_are_those_of_plain_arithmetic(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * (1 + i % 3) for _ in range(64)]) for i in range(120)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (3, rows[3][1]), (4, rows[5][1]), (None, rows[7][1])]  # ties, repeated rows and ids, no id
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "'v' as v", "2 as cluster", "3 as planes")
    p = bitplanes.Params(clusters=7, rounds=4)
    got = sorted((tuple(r) for r in bitplanes.cluster(df, p).collect()), key=repr)
    assert got == brute(rows, p)
    few = bitplanes.cluster(df.where("vec_id in (1, 2)"), p)
    assert sorted((r["cluster"], r["distance"]) for r in few.collect()) == [(0, 0), (1, 0)]
    for none in (df.where("vec_id >= 900"), df.limit(0), df.where("vec_id is null")):
        assert bitplanes.cluster(none, p).count() == 0


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        bitplanes.cluster(df).count()


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(queries.QUERIES["op13_bitplane_kmeans"](spark, folder), duckdb_on(folder), queries.ORACLES["op13_bitplane_kmeans"]) is None
