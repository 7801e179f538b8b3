"""Staged tables, spans of texts and connected components."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import common
from pixelloom.llm.components import components


def tables(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_settled_removes_what_it_staged(spark):
    before = tables(spark)

    def make():
        inner = common.settled(spark, lambda: common.staged(spark.range(5), "inner").where("id > 1"), "middle")
        return common.staged(inner, "outer").where("id > 2")

    kept = common.settled(spark, make, "kept")
    assert sorted(r.id for r in kept.collect()) == [3, 4]
    assert {x.split("-")[0] for x in tables(spark) - before} == {"kept"}
    with pytest.raises(ValueError, match="odd"):
        common.settled(spark, lambda: (_ for _ in ()).throw(ValueError("odd")), "odd")
    common.staged(spark.range(1), "free")
    assert common._open == [] and any(x.startswith("free") for x in tables(spark) - before)


def test_spans_of_bytes():
    texts = pa.array(["a" * 5, None, "b" * 20, "", "c", "d" * 7])
    for most in (1, 4, 8, 25, 1000):
        spans = common.spans_of_bytes(texts, most)
        assert [k for lo, hi in spans for k in range(lo, hi)] == list(range(6)) and all(hi > lo for lo, hi in spans)
        sizes = [sum(len(t or "") for t in texts.slice(lo, hi - lo - 1).to_pylist()) for lo, hi in spans]
        assert all(n < most for n in sizes)  # only the last text of a span goes beyond
    assert common.spans_of_bytes(pa.array([], pa.string())) == [] and common.spans_of_bytes(pa.array([None, None], pa.string())) == [(0, 2)]


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_components(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)  # 0: nothing is broadcast
    rng = random.Random(4)
    edges = [(500, k) for k in range(300)] + [(k, k + 1) for k in range(600, 640)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(90)] + [(650, 650), (641, 620), (641, 620)]
    group = {x: x for e in edges for x in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        group[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
