import random

import pytest
from strandweave.llm import common as m


def components(edges):
    low = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for u, v in edges:
            least = min(low[u], low[v])
            moved |= low[u] != least or low[v] != least
            low[u] = low[v] = least
    linked = {x for u, v in edges if u != v for x in (u, v)}
    return {x: c for x, c in low.items() if x in linked}


@pytest.mark.parametrize("few", [0, 20_000])
def test_components(spark, monkeypatch, few):
    """Random graphs, a chain and a star whose root has most edges, by both ways of looking up."""
    monkeypatch.setattr(m, "FEW_EDGES", few)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(100, 100 + k) for k in rng.sample(range(1, 90), 60)] + [(k, k + 1) for k in range(300, 325)] + [(7, 7)]
    got = m.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == components(edges) and len(got) == len({r["node"] for r in got})


def test_lookup_deals_hot_keys(spark):
    rng = random.Random(4)
    rows = [(i, 0 if i % 3 else rng.randrange(1, 200)) for i in range(900)] + [(1000, 999)]
    left = spark.createDataFrame(rows, "id long, k long")
    right = left.filter("k < 999").groupBy("k").agg(m.F.count("*").alias("n")).withColumn("x", m.F.col("k") * 2)
    for total in (None, 900):
        got = m.lookup(left, right, "k", "n", "id", total, share=5)
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, k, 2 * k) for i, k in rows if k < 999)
        joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "_salt" in x]
        assert any(x.count("_salt") == 2 for x in joins)  # the salt is a key on both sides
    got = m.lookup(left, right, "k", "n", "id", share=5, outer=True)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame([(i, k, 2 * k if k < 999 else None) for i, k in rows], "id long, k long, x long").collect())


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        m.shared_dir(Session())
