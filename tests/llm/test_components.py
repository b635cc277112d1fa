"""Connected components: small graphs in few files, and the same labels however the edges are dealt."""

import random

from tabulon.llm import components


def labels(edges):
    """(node, least node reached) by brute force."""
    group = {}
    for u, v in edges:
        a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
        if a is not b and u != v:
            a |= b
            for x in b:
                group[x] = a
    linked = {x for u, v in edges if u != v for x in (u, v)}
    return sorted((x, min(group[x])) for x in linked)


def test_a_small_graph_stays_in_few_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        edges = [(i, i + 1) for i in range(60) if i % 7] + [(100, i) for i in range(101, 160)]
        found = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(16))
        assert sorted(map(tuple, found.collect())) == labels(edges)
        assert found.select("label").rdd.getNumPartitions() <= 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(key)


def test_dealt_edges_and_shuffled_sides_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(components, "PARTITION_EDGES", 20)
    monkeypatch.setattr(components, "BROADCAST_EDGES", 10)
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(-3, i) for i in range(300, 340)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"))
    assert sorted(map(tuple, found.collect())) == labels(edges)
