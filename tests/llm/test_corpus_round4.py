"""Vector search at size: cost in the dimension, beams for vectors without clusters, islands, float input."""

import time

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import vector_search


def unit_rows(rng, n, dim):
    return vector_search.unit(rng.normal(size=(n, dim)))


def test_directions_cost_in_proportion_to_the_dimension(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 768))
    v[200:] = v[:100] * 2.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    began = time.time()
    got = {(r["node"], r["vec_id"]) for r in vector_search.distinct_directions(vector_search.vector_rows(df), 5).collect()}
    assert time.time() - began < 60  # with the length of a vector computed anew for each component: hours
    assert got == {(i, i) for i in range(200)} | {(i, i + 200) for i in range(100)}


def test_beam_is_widened_for_vectors_without_clusters():
    rng = np.random.default_rng(5)
    x, q = unit_rows(rng, 12000, 48), unit_rows(rng, 200, 48)
    shard = vector_search.Shard.__new__(vector_search.Shard)
    shard.graph = vector_search.Graph.build(x)
    width = shard.width(q, 5, vector_search.SEARCH_BEAM)
    found, _ = shard.graph.beam(q.astype(np.float32), width)
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    hits = sum(len(set(f[:5]) & set(b)) for f, b in zip(found.tolist(), best.tolist(), strict=True))
    assert width > vector_search.SEARCH_BEAM and hits >= 0.9 * 5 * 200
    near = vector_search.unit(x[:2000, :2])  # vectors on a circle: the least width does
    shard.graph = vector_search.Graph.build(near)
    assert shard.width(near[:200], 5, vector_search.SEARCH_BEAM) == vector_search.SEARCH_BEAM


def test_every_node_can_be_reached():
    rng = np.random.default_rng(6)
    x = np.concatenate([vector_search.unit(unit_rows(rng, 1, 16) + 0.01 * rng.normal(size=(k, 16))) for k in [9000] + [3] * 40])
    g = vector_search.Graph.build(x)
    seen = np.zeros(len(x), dtype=bool)
    vector_search._reached(np.where(g.links == np.arange(len(x))[:, None], -1, g.links), g.starts, seen)
    assert seen.all()
    found, _ = g.beam(x[9000:].astype(np.float32), 64)
    for i, f in enumerate(found.tolist()):
        assert {9000 + i // 3 * 3 + j for j in range(3)} <= set(f[:3])


def test_float_vectors_in_many_shards_are_scored_in_double_precision(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    rows = vector_search.vector_rows(df)
    assert rows.schema["v"].dataType.simpleString() == "array<float>"
    index = vector_search.build_index(rows, 5, shard_rows=100)
    assert index.select("shard").distinct().count() == 15 and index.count() == 1500
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "v")
    u = vector_search.unit(v.astype(np.float64))
    hits, got = 0, vector_search.search(index, queries, 5, query_block=16).collect()
    for r in got:
        assert abs(r["score"] - u[r["query_id"]] @ u[r["vec_id"]]) < 1e-12
        hits += r["vec_id"] in set(np.argsort(-(u @ u[r["query_id"]]))[1:6].tolist())
    assert len(got) == 5 * 150 and hits >= 0.98 * 5 * 150
    assert {(r["query_id"], r["rank"]) for r in got} == {(q, k) for q in range(0, 1500, 10) for k in range(1, 6)}
