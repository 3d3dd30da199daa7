"""What scanners, templates and explosions make is not broadcast: its files are a hundredth of its size."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tersa.operators import graph as G

#: Queries of the import graph; broadcasts that their plans may hold (the first few files of each folder).
ALLOWED = {"import_graph": 0, "importers_ranked": 0, "test_map": 0, "tested_exports": 0, "risk_score": 0, "analyze": 0, "related_files": 1}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ALLOWED)
def test_made_rows_are_not_broadcast(spark, small, name):
    found = plan(entry.queries()[name](spark, small))
    assert found.count("BroadcastExchange") <= ALLOWED[name]


@pytest.mark.parametrize("name", ["dependency_tree", "guard"])
def test_edges_are_made_without_broadcasts(spark, small, name, monkeypatch):
    written, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: written.append((label, plan(df))) or write(df, label))
    entry.queries()[name](spark, small)
    assert written[0][0] == "edges" and "BroadcastExchange" not in written[0][1]


@pytest.mark.parametrize("name", ["dependency_tree", "guard"])
def test_walks_broadcast_nothing(spark, small, name, monkeypatch):
    plans, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: plans.append(plan(df)) or write(df, label))
    plans.append(plan(entry.queries()[name](spark, small)))
    assert sum(p.count("BroadcastExchange") for p in plans) == 0
    assert sum(p.count("MapInArrow") for p in plans) == 1  # files are scanned once


def test_a_file_is_found_by_each_of_its_names(spark):
    paths = ["a.ts", "a.js", "b/index.ts", "b.py", "c.js.ts", "c.ts", "d.test.js", "/index.js", None]
    files = spark.createDataFrame([(p,) for p in paths + paths], "path string")
    wanted = {"a": "a.ts", "a.js": "a.js", "a.mjs": "a.ts", "b": "b.py", "b/index": "b/index.ts", "b/index.js": "b/index.ts", "c.js": "c.js.ts", "c.jsx": "c.ts", "d.test": "d.test.js", "": "/index.js", "none": None, None: None}
    imports = spark.createDataFrame([(None, spec, None) for spec in wanted for _ in range(2)], "path string, spec string, lang string")
    resolved = G.resolve(imports, files)
    assert sorted((str(r["spec"]), r["resolved"]) for r in resolved.collect()) == sorted((str(k), v) for k, v in wanted.items() for _ in range(2))
