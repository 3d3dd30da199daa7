"""The walk that finds cycles of any length, against a plain one, whole and split over tasks."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
from tersa.operators import graph as G
from tersa.plans import source_queries


def plain(pairs: list[tuple[str, str]]) -> set[tuple[str, ...]]:
    """One cycle for every edge back to an open node; strong components by reachability, each from its smallest node."""
    nodes = sorted({x for pair in pairs for x in pair})
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    next_ = {x: sorted({b for a, b in pairs if a == x != b and x in reach[b]}) for x in nodes}
    colour, out = {}, []

    def walk(u, line):
        colour[u] = "open"
        for v in next_[u]:
            if colour.get(v) == "open":
                path = line[line.index(v) :]
                least = path.index(min(path))
                out.append(tuple(path[least:] + path[:least]))
            elif v not in colour:
                walk(v, [*line, v])
        colour[u] = "done"

    for x in nodes:
        if x not in colour:
            walk(x, [x])
    assert len(out) == len(set(out))
    return set(out)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ring(name: str, n: int) -> list[tuple[str, str]]:
    return [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]


@pytest.mark.parametrize("n", [3, 4, 9])
def test_guard_finds_cycles_of_any_length(spark, small, monkeypatch, n):
    monkeypatch.setattr(source_queries, "_edges", lambda *_: frame(spark, [*ring("a", n), ("a0", "b"), ("c", "a1"), ("c", "c")]))
    rows = {r["check_name"]: (r["n"], r["verdict"]) for r in entry.queries()["guard"](spark, small).collect()}
    assert rows["cycles"] == (1, "warn")


@pytest.mark.parametrize("task", [G.TASK, 5])
def test_walked_cycles_equal_a_plain_walk(spark, task):
    dice = random.Random(7)
    pairs = [(f"r{dice.randrange(12)}", f"r{dice.randrange(12)}") for _ in range(24)] + [(f"s{dice.randrange(9)}", f"s{dice.randrange(9)}") for _ in range(14)]
    pairs += ring("t", 6) + ring("u", 2) + [("t0", "u0"), ("a", "t3"), ("u1", "z"), (None, "t0"), ("t0", None)] + [(f"x{i}", f"x{i + 1}") for i in range(9)]
    want = plain([p for p in pairs if None not in p])
    assert {tuple(r["path"]) for r in G.walk_cycles(frame(spark, pairs + pairs), task).collect()} == want
    assert sorted(r["nodes"] for r in G.cycle_sizes(frame(spark, pairs), task).collect()) == sorted(map(len, want))


@pytest.mark.parametrize("task", [G.TASK, 2])
def test_no_cycles(spark, task):
    for pairs in ([], [("a", "a")], [(f"n{i}", f"n{i // 2}") for i in range(40)], [(f"n{i}", f"n{i + 1}") for i in range(40)]):
        assert G.cycle_sizes(frame(spark, pairs), task).count() == 0
        assert G.walk_cycles(frame(spark, pairs), task).count() == 0


def test_few_edges_that_stay_end_the_rounds(spark):
    assert [r["nodes"] for r in G.cycle_sizes(frame(spark, ring("a", 4)), 2).collect()] == [4]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (102, 103)], "u long, v long")
    assert {(r["node"], r["root"]) for r in G.components(links).collect()} == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 104)}
