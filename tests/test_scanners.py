"""Known answers of the source scanners, the import graph, scalar functions and readers, with null, empty and repeated input."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tersa.functions import text as X
from tersa.operators import audit as A, classify as C, code as K, graph as G, pages as W, readers as R, rules as U
from tersa.operators.tables import materialize
from tersa.streaming import events as E

JS = """import fs from 'fs';
import { a as b, c } from './util.js';
import * as lib from "lib";
export { z as y } from './z';
const q = require('q');
/** Says hi.
 * @param x thing
 */
export class Store extends Base {
  load(key) {
    if (key) { return get(key); }
  }
}
export async function get(key, o = {}) {
  const s = "{ not a brace";
  return read(key);
}
const read = (key) => {
  return fs.readFileSync(key);
};
export { read as fetch };
try { x(); } catch (e) { throw new MyError("x"); }
"""
RUBY = """module M
  class Foo < Bar
    def self.go(x)
      return 1 if x
      if x
        y.each do |z|
          run(z)
        end
      end
    end
    private
    def hid?
      "end"
    end
  end
end
"""


def found(what, text, lang):
    return list(K.SCANS[what][0](K.Source(text, lang)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_script():
    assert [x[:4] for x in found("symbols", JS, "javascript")] == [("class", "Store", 9, 13), ("method", "load", 10, 12), ("function", "get", 14, 17), ("function", "read", 18, 20)]
    assert [(x[0], x[2], x[3]) for x in found("imports", JS, "javascript")] == [("fs", "static", ("fs",)), ("./util.js", "static", ("b", "c")), ("lib", "static", ("*",)), ("./z", "re-export", ("y",)), ("q", "require", ("q",))]
    assert [x[0] for x in found("exports", JS, "javascript")] == ["y", "Store", "get", "fetch"]
    assert found("calls", JS, "javascript") == [("load", "get", 11), ("get", "read", 16)]
    assert found("docs", JS, "javascript")[0] == ("Store", "class", 9, "Says hi.", ["param x thing"])
    assert found("errors", JS, "javascript") == [("catch", "e", 22), ("throw", "MyError", 22)]


def test_end_keywords():
    assert [x[:4] for x in found("symbols", RUBY, "ruby")] == [("module", "M", 1, 16), ("class", "Foo", 2, 15), ("function", "go", 3, 10), ("function", "hid?", 12, 14)]
    assert [x[0] for x in found("exports", RUBY, "ruby")] == ["M", "Foo", "go"]
    assert [x[1] for x in found("snippets", RUBY, "ruby")] == ["M", "M.Foo", "Foo.go", "Foo.hid?"]


def test_python_and_generic():
    source = "import os, sys as s\nfrom a.b import (c,\n   d as e)\ndef f(\n  x,\n):\n    return g(x)\nLIMIT = 3\n"
    assert [(x[0], x[3]) for x in found("imports", source, "python")] == [("os", ()), ("sys", ("s",)), ("a.b", ("c", "e"))]
    assert [x[0] for x in found("exports", source, "python")] == ["f", "LIMIT"] and found("exports", "__all__ = ['a', \"b\"]\ndef c(): pass\n", "python") == [("a", 1, "list"), ("b", 1, "list")]
    assert [x[:2] for x in found("symbols", "public class A {\n  int run(int x) {\n    return x;\n  }\n}\n", "java")] == [("class", "A"), ("function", "run")]
    assert [x[0] for x in found("imports", "import java.util.List;\nusing x;\n", "java")] == ["java.util.List", "x"]


@pytest.mark.parametrize("lang", ["javascript", "typescript", "python", "go", "rust", "ruby", "lua", "java", "shell", ""])
def test_no_scanner_fails_on_odd_text(lang):
    for text in ("", "\n", "{{{", "}}}", "end end end", "def", "class", "'", '"""', "import", "import (", "export {", "/*", "`", "function (", "x" * 5000, "{" * 300 + "}" * 299, "é ß 🙂 def é():", JS, RUBY):
        for what in K.SCANS:
            list(K.SCANS[what][0](K.Source(text, lang)))


@pytest.mark.parametrize(("command", "segments"), [("a && b || c; d", ["a", "b", "c", "d"]), ("a 'x && y' && b", ["a 'x && y'", "b"]), ("a & b", []), ("cat <<E && x", []), ("(a && b)", []), ("a;;b", []), ('a "$(x && y)" ; z', ['a "$(x && y)"', "z"]), ("a && 'b", []), ("a | b && c", ["a | b", "c"])])
def test_chains(command, segments):
    assert [x[2] for x in found("chains", command, "shell")] == segments


def test_scan_bears_nulls_and_clashes(spark):
    files = spark.createDataFrame([("a.js", "javascript", JS, "x"), ("b.js", None, None, "x"), (None, "python", "def f(): pass", "x"), ("a.js", "javascript", JS, "x")], "path string, lang string, content string, name string")
    assert K.scan(files, "symbols").count() == 9
    assert K.scan(files.limit(0), "symbols").count() == 0
    assert K.snippets(files, "a.js:Store.load").select("line").distinct().collect()[0][0] == 10
    assert K.first_lines(K.scan(files, "symbols"), ["name"], 1).count() == 5


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/lib/index.js", "src/lib/b.js", "src/@app/c.ts", "x/d.py")], "path string")
    rows = [("src/a.ts", "./lib", "typescript"), ("src/a.ts", "./lib/b", "typescript"), ("src/a.ts", "./lib/b.ts", "typescript"), ("src/lib/b.js", "../a", "javascript"), ("src/a.ts", "~/c", "typescript"), ("src/a.ts", "fs", "typescript"), ("src/a.ts", "react", "typescript"), ("src/a.ts", "./gone", "typescript"), ("x/e.py", "x.d", "python")]
    imports = spark.createDataFrame(rows, "path string, spec string, lang string")
    got = {(r["path"], r["spec"]): (r["resolved"], r["module"]) for r in G.resolve(imports, files, {"~": "src/@app"}).collect()}
    assert [got[r[:2]] for r in rows] == [("src/lib/index.js", "local"), ("src/lib/b.js", "local"), ("src/lib/b.js", "local"), ("src/a.ts", "local"), ("src/@app/c.ts", "local"), (None, "builtin"), (None, "package"), (None, "unresolved"), ("x/d.py", "local")]


def test_trees(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("a", "a"), ("a", "b")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    got = {(r["node"], r["parent"], r["depth"], r["circular"]) for r in G.dependency_tree(edges, roots, 3).collect()}
    assert got == {("b", "a", 1, False), ("c", "a", 1, False), ("d", "c", 2, False), ("a", "c", 2, True)}
    assert {r["node"] for r in G.dependency_tree(edges, roots, 3, cap=1).collect()} == {"b"}
    assert [r["path"] for r in G.cycles(edges, 3).orderBy("path").collect()] == [["a", "b", "c"], ["a", "c"]]


def test_scalars(spark):
    pairs = [
        (X.shell_quote(F.lit("it's")), "'it'\\''s'"), (X.capitalize(F.lit("abc")), "Abc"), (X.count_braces(F.lit('if (x) { "}" // }')), 1), (X.epoch_ms(F.lit("1970-01-01T00:00:01Z")), 1000), (X.epoch_ms(F.lit("no")), None),
        (X.elapsed(F.lit(850)), "850ms"), (X.elapsed(F.lit(12_345)), "12.3s"), (X.elapsed(F.lit(125_000)), "2m 5s"), (X.size_bytes(F.lit("1.5 MB")), 1_572_864), (X.size_bytes(F.lit("12")), 12), (X.size_bytes(F.lit("many")), None),
        (X.indent_size(F.lit("a\n  b\n  c\n    d")), "2"), (X.indent_size(F.lit("a\n\tb")), "tab"), (X.indent_size(F.lit("a")), None), (X.percent_of(F.lit(1), F.lit(3)), 33), (X.percent_of(F.lit(1), F.lit(0)), 0),
        (X.tool_arguments(F.lit('{"command":"ls"}'), "command"), "ls"), (X.tool_arguments(F.lit('"{\\"command\\":\\"ls\\"}"'), "command"), "ls"), (X.content_text(F.lit('"plain"')), "plain"), (X.content_text(F.lit('[{"type":"text","text":"a"},{"type":"x"},{"text":"b"}]')), "a\nb"),
        (X.short_hash(F.lit("x"), "md5"), "9dd4e461268c"), (X.dirname(F.lit("a/b/c.js")), "a/b"), (X.dirname(F.lit("c.js")), ""), (G.normal_path(F.lit("./a/../b/./c")), "b/c"), (U.rewritten(F.lit('npm test "x"')), 'run "npm test \\"x\\""'), (U.rewritten(F.lit("run x")), None),
        (C.contains_path(F.lit("/a/"), F.lit("/a/b")), True), (C.contains_path(F.lit("/a"), F.lit("/ab")), False), (C.contains_path(F.lit("/a"), F.lit("/a")), True),
        (X.time_until(F.lit("2024-01-03 04:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")), "2d 4h"), (X.time_until(F.lit("2024-01-01 00:45:30").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")), "45m"),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(pairs))).first()
    assert [row[i] for i in range(len(pairs))] == [want for _, want in pairs]
    assert X.deep_merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"c": 3}, "d": [2]}) == {"a": {"b": 1, "c": 3}, "d": [2]}


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    from tersa.operators import tables

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Far)
    assert materialize(spark.range(3), "test").count() == 3


def test_first_matching_rules(spark):
    """The rules of an audit in their order: a build hides a tail, a cat that is short hides a curl."""
    long, short = "x\n" * 400, "y" * 600
    calls = [("Read", "a.py", long, "read-large-file"), ("Read", "a.md", long, None), ("Read", "a.py", short, None), ("Bash", "npm test && tail x", short, "build-test-output"), ("Bash", "tail x && curl http://e.com/a", short, "tail-command"), ("Bash", "cat a.py", short, None), ("Bash", "cat a.py", long, "cat-large-file"), ("Bash", "cat a.json", long, None), ("Bash", "head -5 x; curl https://e.com", short, "head-command"), ("Bash", "curl https://e.com/a", short, "curl-command"), ("Bash", "curl http://localhost:3000", short, None), ("Bash", "curl -d x https://e.com", short, None), ("WebFetch", "https://e.com", short, "webfetch"), ("WebFetch", "https://e.com", "tiny", None), ("Grep", "x", long, None)]
    frame = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(calls)], "i int, tool string, argument string, result string")
    got = {r["i"]: r["category"] for r in A.findings(frame, F.col("tool"), F.col("argument"), F.col("result")).collect()}
    assert [got.get(i) for i in range(len(calls))] == [c[3] for c in calls]


def test_readers_bear_odd_lines(spark):
    lines = spark.createDataFrame([("x", i, t) for i, t in enumerate(["", "no commit", "a.js", "+++ b/x", "@@ bad", None])], "doc string, pos int, line string")
    assert R.git_log(lines).count() == R.numstat(lines).count() == R.porcelain(lines).count() == R.diff_stat(lines).count() == 0
    assert R.statement_coverage(spark.createDataFrame([("{bad",), (None,)], "report string")).count() == 0
    long = "+" + "z" * 20_000
    diff = spark.createDataFrame([("d", i, t) for i, t in enumerate(["+++ b/a", "@@ -1 +1,2 @@", long])], "doc string, pos int, line string")
    assert R.added_lines(diff).first()["text"] == long[1:]


def test_threads(spark):
    assert one(spark, W.as_text(F.lit("text/markdown"), F.lit("# <b>"))) == "# <b>"
    assert one(spark, W.as_text(F.lit("text/html; charset=x"), F.lit("<p>a</p>"))) == "a"
    assert one(spark, W.thread_url(F.lit("example.com/r/x"))) is None


def test_validity(spark):
    rows = spark.createDataFrame([("h", "h", "f", "f", 9000, True), ("h", "g", "f", "f", 1, False), ("h", "h", "f", "x", 1, False), (None, None, "", "", 300, True), (None, None, "", "", 301, False)], "kept string, head string, was string, files string, age int, want boolean")
    assert rows.where(E.still_valid(F.col("kept"), F.col("head"), F.col("was"), F.col("files"), F.col("age")) != F.col("want")).count() == 0


def test_runs_are_kept(spark, tmp_path):
    run = lambda *lines: spark.createDataFrame([("k", list(lines))], "key string, lines array<string>")
    R.keep_runs(run("a fails", "b fails"), str(tmp_path / "runs"))
    got = R.against_previous(run("b fails", "c fails"), spark.read.parquet(str(tmp_path / "runs")), "key", "lines").first()
    assert (got["fresh"], got["gone"]) == (["c fails"], ["a fails"])
    assert one(spark, R.snapshot_key(F.lit("/p"), F.lit("npm test"))) == hashlib.md5(b"/p:npm test").hexdigest()[:12]
