"""Centroid clustering against plain assignment, and its odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import centroids

ROWS = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, scale=64):
    x = np.array([[int(np.floor(scale * c)) for c in v] for _, v in rows], np.int64)
    key = lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), list(x[i]))
    c = x[sorted(range(len(x)), key=key)[:k]]
    for step in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if step < rounds:
            c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    return own, d.min(axis=1), c


@pytest.mark.parametrize("dims,bits", [(12, 3), (7, 5)])
def test_equals_plain_assignment_with_ties_repeats_and_odd_rows(spark, dims, bits):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(700, dims)) + 3 * rng.integers(-1, 2, (700, 1))
    x[100:330] = x[100]
    x[400:500] = np.round(x[400:500])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist())] * 3 + [(None, x[9].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [float("nan")] * dims), (904, [None] * dims), (905, [float("inf")] * dims)]
    df = spark.createDataFrame(rows + odd, ROWS).withColumns({"cluster": F.lit("x"), "cells": F.lit(1), "vec": F.lit(2)}).repartition(5)
    found = centroids.cluster(df, k=8, rounds=3, dims=dims, bits=bits)
    own, distance, c = plain(rows, 8, 3)
    assert found.centroids == c.tolist()
    order = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()), key=order)
    assert got == sorted(((i, int(a), int(d)) for (i, _), a, d in zip(rows, own, distance)), key=order)
    compared = found.assigned.agg(F.avg("compared")).first()[0]
    assert compared < 8
    sums = {r.cluster: r for r in centroids.inertia(found).dropDuplicates(["cluster"]).collect()}
    for j, r in sums.items():
        assert r.cluster_inertia == distance[own == j].sum() and r.inertia == distance.sum()
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()


def test_few_equal_huge_or_no_vectors(spark):
    few = centroids.cluster(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], ROWS), dims=2)
    assert [tuple(r) for r in few.assigned.orderBy("vec_id").collect()] == [(1, 0, 0, 2), (2, 0, 0, 2)] and few.centroids == [[32, -32]] * 2
    huge = centroids.cluster(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], ROWS), dims=2)
    assert sorted(map(tuple, huge.centroids)) == [(0, 0), (centroids.MOST, -centroids.MOST)]
    none = centroids.cluster(spark.createDataFrame([(1, [0.5])], ROWS), dims=2)
    assert none.assigned.count() == 0 and centroids.inertia(none).count() == 0
    floats = spark.createDataFrame([(1, [0.1, 0.2])], "vec_id int, embedding array<float>")
    assert centroids.cluster(floats, dims=2).centroids == [[6, 12]]
