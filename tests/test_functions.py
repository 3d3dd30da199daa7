"""Known answers of column functions and operators, with null, empty and repeated input."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tersa.functions import text as X
from tersa.operators import audit as A, budget as B, classify as C, duplicates as D, graph as G, logs as L, ranking as R, stats as S
from tersa.operators import readers
from tersa.operators.tables import materialize
from tersa.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "words"), [("getUserId", ["get", "user", "id"]), ("HTTPRequest", ["http", "request"]), ("strip-ansi", ["strip", "ansi"]), ("", []), (None, [])])
def test_identifier_words(spark, text, words):
    assert one(spark, X.identifier_words(F.lit(text))) == words


def test_estimates(spark):
    assert one(spark, X.token_estimate(F.lit("abcde"))) == 2
    assert one(spark, X.body_tokens(F.lit(None).cast("string"))) == 1
    assert [one(spark, X.format_tokens(F.lit(n))) for n in (999, 1000, 9950, 2_340_000)] == ["999", "1.0k", "10.0k", "2.3M"]


def test_structure(spark):
    assert one(spark, X.structural_body(F.lit("return  foo + bar; // note"))) == "return _ + _;"
    assert one(spark, X.code_tokens(F.lit("a1 + b"))) == 3
    assert one(spark, X.strip_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"


def test_log_template(spark):
    line = "2024-01-02T03:04:05Z id 550e8400-e29b-41d4-a716-446655440000 at 0xff took 12 in deadbeef00"
    assert one(spark, X.log_template(F.lit(line))) == "<ts> id <uuid> at <hex> took <n> in <hex>"


def test_markup(spark):
    assert one(spark, X.decode_entities(F.lit("&amp;lt;"))) == "<"
    assert one(spark, X.markdown(F.lit('<nav>no</nav><main><h2>T</h2><p>a <a href="u">b</a></p></main>'))) == "## T\n\na [b](u)"


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.js", "a/b.js", True), ("*.js", "a/b.js", False), ("src/?.py", "src/a.py", True), ("src/**", "src/a/b", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(X.glob_pattern(glob))) is hit


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    texts = base + [[*b[:-1], "zz"] for b in base] + base[:5]
    sets = {i: {" ".join(t[k : k + 2]) for k in range(max(1, len(t) - 1))} for i, t in enumerate(texts)}
    frame = materialize(spark.createDataFrame([(i, len(texts[i]), sorted(s)) for i, s in sets.items()], "id int, tok int, s array<string>"), "t")
    got = {(r.a, r.b): r.similarity for r in D.near_pairs(frame, "id", "tok", "s", 0.7).collect()}
    want = {}
    for a, b in itertools.combinations(sets, 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.7 and max(len(texts[a]), len(texts[b])) <= 1.25 * min(len(texts[a]), len(texts[b])):
            want[a, b] = j
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert not D.near_pairs(frame.limit(0), "id", "tok", "s", 0.7).collect()


def test_lookup(spark):
    rows = spark.createDataFrame([("getUserId", "getUserId(user)", "return user.id", 1), ("parse", "parse(text)", "x", 2), (None, None, None, 3)], "name string, signature string, body string, line int")
    found = R.lookup(rows, "getUserId").collect()
    assert found[0]["name"] == "getUserId" and found[0]["score"] >= 0.9
    assert R.lookup(rows, "quaternion slerp").count() == 0 and R.lookup(rows, "").count() == 0


def test_quantiles_by_brute_force(spark):
    rng = random.Random(1)
    rows = [("a", float(rng.randint(0, 50))) for _ in range(3001)] + [("b", 1.0), ("c", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.37, 0.5, 0.95, 1.0):
        got = {r.k: r["quantile"] for r in S.quantiles(frame, "k", "v", q).collect()}
        want = {r.k: r.p for r in frame.where("v is not null").groupBy("k").agg(F.percentile("v", q).alias("p")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_budget_never_exceeds(spark):
    rows = spark.createDataFrame([(d, i, "x" * (7 * i % 50)) for d in (1, 2) for i in range(1, 40)], "d int, pos int, line string")
    kept = B.prefix(rows, "d", "pos", "line", 20, 60).collect()
    for d in (1, 2):
        own = sorted(r.pos for r in kept if r.d == d)
        assert own == list(range(1, len(own) + 1)) and len(own) <= 20
    assert B.line_budget(None, None) is None and B.line_budget(100, 600) == 35


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("a", "a")], "src string, dst string")
    reached = {r.node: r.depth for r in G.impact(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert reached == {"c": 1, "d": 1, "b": 2, "e": 2}
    assert [r.path for r in G.cycles(edges, 3).collect()] == [["a", "b", "c"]]
    assert one(spark, G.import_kind(F.lit("node:fs"), F.lit(None).cast("string"))) == "builtin"


def test_clusters_and_runs(spark):
    lines = ["ERROR db connection failed"] * 2 + ["INFO heartbeat ok"] * 3 + ["WARN retry 1", "WARN retry 2"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos int, line string")
    by_key = {r.key: (r.n, r.severity) for r in L.clusters(rows, "line", "pos").collect()}
    assert by_key == {"ERROR db connection failed": (2, "error"), "INFO heartbeat ok": (3, "info"), "WARN retry <n>": (2, "warn")}
    assert sorted(r.n for r in L.runs(rows, F.col("line"), "pos").collect()) == [1, 1, 2, 3]


def test_audit_of_nothing(spark):
    nothing = spark.createDataFrame([], "tool string, argument string, result string")
    found = A.findings(nothing, F.col("tool"), F.col("argument"), F.col("result"))
    assert found.count() == 0 and A.plan(found).count() == 0
    calls = spark.createDataFrame([("Bash", "npm run test", "x\n" * 300), ("Read", "a.py", "l\n" * 260), ("Read", "a.md", "l\n" * 260), ("Bash", "cat a.js", "short")], "tool string, argument string, result string")
    assert sorted(r.category for r in A.findings(calls, F.col("tool"), F.col("argument"), F.col("result")).collect()) == ["build-test-output", "read-large-file"]


def test_classes_of_null(spark):
    assert one(spark, C.semver(F.lit(None).cast("string"))) is None
    assert one(spark, C.marker(F.lit("nothing"))) is None


def test_expiring_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(u, start + datetime.timedelta(minutes=m)) for u, m in ((1, 0), (1, 10), (1, 16), (1, 20), (2, 5), (2, 21), (1, 31))]
    frame = spark.createDataFrame(rows, "u long, ts timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    batch = sorted((r.u, r.ts) for r in E.expire(frame, "u", "ts", 900.0, []).collect())
    stream = E.expire_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "u", "ts", 900.0)
    running = stream.writeStream.outputMode("append").format("memory").queryName("expired").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    running.awaitTermination()
    assert sorted((r.u, r.ts) for r in spark.table("expired").collect()) == batch and len(batch) == 5


def test_files_and_json_lines(spark, tmp_path):
    from tersa.sources.tables import files, json_lines, text_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "s.jsonl").write_text('{"type": "call", "id": 1}\r\nnot json\n{"type": "result", "id": 1}\n')
    assert [(r.size, r.path.endswith("x.py")) for r in files(spark, str(tmp_path), "*.py").collect()] == [(9, True)]
    assert [r.content for r in text_files(spark, str(tmp_path), "*.py").collect()] == ["print(1)\n"]
    assert sorted(r.type for r in json_lines(spark, str(tmp_path / "s.jsonl"), "type string, id int").collect()) == ["call", "result"]
    assert json_lines(spark, str(tmp_path / "s.jsonl"), "type string", containing="result").count() == 1


def test_containing_function(spark):
    rows = spark.createDataFrame([("f", 1, "a"), ("f", 2, None), ("f", 5, "b"), ("f", 6, None), ("g", 1, None)], "file string, line int, name string")
    found = {(r.file, r.line): r.container for r in G.containing(rows, "file", "line", F.col("name")).collect()}
    assert found == {("f", 1): "a", ("f", 2): "a", ("f", 5): "b", ("f", 6): "b", ("g", 1): None}


def test_long_lines_keep_their_end(spark):
    name, text = "d/" * 6000 + "f", "x" * 12_000 + " secret"
    diff = spark.createDataFrame([("a", 0, "+++ b/" + name), ("a", 1, "@@ -0,0 +1 @@"), ("a", 2, "+" + text)], "doc string, pos int, line string")
    assert [tuple(r) for r in readers.added_lines(diff).collect()] == [(name, 1, text)]
    report = spark.createDataFrame([("a", 0, "SF:" + name), ("a", 1, "DA:3,1")], diff.schema)
    assert readers.lcov(report).first()["source"] == name
