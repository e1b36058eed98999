"""Quantiles and places of large groups against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import logs, order, retrieval, sqo


def values(kind, n, rng):
    return {
        "even": [rng.uniform(-5, 5) for _ in range(n)],
        "steep": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "copies": [rng.choice([0.0, 0.0, 0.0, 1.5, rng.random()]) for _ in range(n)],
        "one": [7.0] * n,
        "whole": [float(rng.randint(-3, 3)) for _ in range(n)],
    }[kind]


@pytest.mark.parametrize("limit", [100_000, 50])
def test_quantiles_equal_plain_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(order, "SORTED_VALUES", limit)
    monkeypatch.setattr(order, "CUTS", 20)
    rng = random.Random(7)
    data = {k: values(k, n, rng) for k, n in (("even", 4_000), ("steep", 3_000), ("copies", 3_000), ("one", 2_000), ("whole", 2_500))}
    data[None] = [1.0, 4.0]
    data["single"] = [3.0]
    rows = [(k, v) for k, own in data.items() for v in own] + [("nothing", None), ("even", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(5)] for r in order.quantiles(df, "v", ps, ["g"]).collect()}
    assert got.pop("nothing") == [None] * 5
    assert got.keys() == data.keys()
    for k, own in data.items():
        assert np.allclose(got[k], np.quantile(own, ps), rtol=1e-12), k
    whole = order.quantiles(df, "v", [0.5], names=["m"]).collect()
    assert len(whole) == 1 and np.isclose(whole[0].m, np.median([v for _, v in rows if v is not None]))


def test_describe_and_medians(spark, monkeypatch):
    monkeypatch.setattr(order, "SORTED_VALUES", 10)
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i * i % 101, f"{i}") for i in range(300)], "g long, v long, s string")
    got = {r.g: (r["count"], r.p25, r.p50, r.p75, r.max) for r in logs.describe(df, "v", ["g"]).collect()}
    for g in (None, 1, 2):
        own = [i * i % 101 for i in range(300) if (i % 3 or None) == g]
        assert got[g] == (100, *np.quantile(own, [0.25, 0.5, 0.75]), max(own))
    assert logs.describe(df, "v").first().p50 == np.median([i * i % 101 for i in range(300)])
    assert [r.v for r in sqo.group_aggregate(df, "g", "v", "median").collect()] == [np.median([i * i % 101 for i in range(300) if i % 3 == g]) for g in (1, 2)]
    assert sqo.group_aggregate(df, [], "s", "quantile").collect() == [(149.5,)]
    assert sqo.group_aggregate(df.limit(0), [], "v", "median").collect() == [(None,)]
    assert sqo.group_aggregate(df.limit(0), ["g"], "v", "median").collect() == []


def test_places_without_a_window_over_a_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(20)]), f"h{rng.randint(0, 30)}") for _ in range(3_000)]
    df = spark.createDataFrame(rows, "source string, score long, h string").repartition(6)
    got = order.placed(df, ["source"], [(F.col("score"), True), (F.col("h"), False)]).collect()
    for source in ("a", "b", None):
        own = sorted((r for r in got if r.source == source), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        keys = [(r.score is None, -(r.score or 0), r.h) for r in own]
        assert keys == sorted(keys)
    assert len(got) == len(rows)
    assert order.placed(df.limit(0), [], [(F.col("h"), False)]).collect() == []


def test_fusion_by_content(spark):
    rows = [("a", "x", 3.0), ("a", "y", None), ("a", "x", 1.0), ("b", "y", 2.0), ("b", "z", 2.0)]
    out = {r.content: round(r.score, 9) for r in retrieval.rrf_by_content(spark.createDataFrame(rows, "source_type string, content string, score double")).collect()}
    import hashlib

    first, second = sorted("yz", key=lambda c: hashlib.md5(c.encode()).hexdigest())
    want = {"x": 1 / 61 + 1 / 62, "y": 1 / 63, "z": 0.0}
    want[first] += 1 / 61
    want[second] += 1 / 62
    assert out == {k: round(v, 9) for k, v in want.items()}
