"""Sampled neighbours compute their neighbour table once."""

import math

from tastegrid.operators import graph


def test_neighbours_are_computed_once(spark):
    rows = [(s, d, float((s * d) % 5), d) for s in range(6) for d in range(1, 5 if s else 2)]
    table = spark.createDataFrame(rows, "src long, dst long, weight double, rank int")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    nodes = spark.createDataFrame([(n,) for n in range(8)], "src long")
    got = graph.sample_neighbours(table.mapInPandas(counted, table.schema), 3, "softmax", nodes=nodes).collect()
    assert read.value == len(rows)
    assert len(got) == 24 and all(r.dst == 0 and r.weight == 0 for r in got if r.src in (6, 7))
    weights = {(s, d): w for s, d, w, _ in rows}
    for s in range(6):
        slots = [r for r in got if r.src == s]
        total = sum(math.exp(weights[s, r.dst]) for r in slots)
        assert len(slots) == 3 and all(abs(r.weight - math.exp(weights[s, r.dst]) / total) < 1e-12 for r in slots)
        assert {r.dst for r in slots} == ({1, 2, 3} if s else {1})
