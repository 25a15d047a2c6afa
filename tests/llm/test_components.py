"""Components against union-find in plain Python."""

from __future__ import annotations

import random

import pytest

from wakelens.llm import components as cc


def expected(edges):
    up = {v: v for e in edges for v in e}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in up}


def chain(n):
    return [(k, k + 1) for k in range(n)]


RNG = random.Random(2)
MIX = list(range(400))
RNG.shuffle(MIX)
GRAPHS = {
    "none": [],
    "loops": [(3, 3), (3, 3), (4, 5), (4, 4)],
    "random": [(RNG.randint(-300, 300), RNG.randint(-300, 300)) for _ in range(250)],
    "chain": chain(300),
    "mixed chain": [(MIX[a], MIX[b]) for a, b in chain(399)],
    "stars": [(k, -(k % 5)) for k in range(1, 200)] + [(0, -9)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("held", [1 << 21, 2])
def test_components(spark, monkeypatch, name, held):
    monkeypatch.setattr(cc, "HELD_EDGES", held)
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "node long, hub long").repartition(7)
    got = cc.components(df).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == expected(edges)


def test_edges_shrink(spark):
    """A group whose sets share many lists leaves a task as one star."""
    edges = [(s, h) for s in range(10, 200) for h in range(10)]
    found = cc._shrunk(spark.createDataFrame(edges, "a long, b long").coalesce(1))
    assert found.count() == 199
