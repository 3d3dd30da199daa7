"""Scanners, imports, tests and reports over the project that ``project`` makes of the ``part`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classify as C, code as K, graph as G, rules as R
from ..operators.tables import sorted_side
from ..sources.tables import lines
from . import project as P
from .registry import query

_FUNCTIONS = {kind: [(name, line, end) for k, name, line, end, _ in facts if k in K.FUNCTIONS] for kind, facts in P.SYMBOLS.items()}


def _scan(spark, d, what, tests=False):
    return K.scan(P.files(spark, d, tests), what).drop("lang")


@query(P.expected("name, line, end_line", _FUNCTIONS))
def function_index(spark, d):
    return _scan(spark, d, "functions").select("path", "name", "line", "end_line")


@query(P.expected("kind, name, line, end_line, parent", P.SYMBOLS))
def symbols(spark, d):
    return _scan(spark, d, "symbols")


@query(f"SELECT path, kind, name FROM ({P.expected('kind, name, line, end_line, parent', P.SYMBOLS)}) WHERE kind IN ('class', 'interface')")
def symbols_by_kind(spark, d):
    return K.by_kind(_scan(spark, d, "symbols"), "class", "interface").select("path", "kind", "name")


@query(f"SELECT path, count(*) AS symbols FROM ({P.expected('kind, name, line, end_line, parent', P.SYMBOLS)}) GROUP BY path")
def symbol_counts(spark, d):
    return K.counted(_scan(spark, d, "symbols"))


@query(P.expected("name", {0: [("f~k~",), ("hidden~k~",)], 1: [("View~k~",)], 2: [("load",), ("f~k~",), ("_hidden~k~",)], 3: [("Run~k~",), ("f~k~",)], 4: [("show~k~",), ("f~k~",)], 5: [("f~k~",), ("go~k~",)]}))
def fast_names(spark, d):
    """Names of functions by one expression; methods without a keyword are left to ``function_index``."""
    return K.fast_names(P.files(spark, d))


_RUN = "  run(x) {\n    try { return f~k~(x); } catch (e) { throw new E~e~Error(\"x\"); }\n  }"
_LOAD = "    def load(self, key):\n        return f~k~(key)"
_GO = "    def self.go~k~(x)\n      return ~s~ if x.nil?\n      x.each do |y|\n        f~k~(y)\n      end\n    end"


@query(P.expected("qualified, line, end_line, text", {0: [("C~k~.run", 16, 18, _RUN)], 2: [("C~k~.load", 10, 11, _LOAD)], 5: [("C~k~.go~k~", 6, 11, _GO)]}))
def snippet_bodies(spark, d):
    """Whole definitions of members, by braces, indentation and end keywords."""
    found = _scan(spark, d, "snippets")
    return found.where("qualified rlike '[.](run|load|go[0-9]+)$'").select("path", "qualified", "line", "end_line", "text")


@query(f"SELECT path, 'C' || k || '.run' AS qualified FROM (SELECT k, {P.path_sql()} AS path FROM {P._ROWS} WHERE k % 6 = 0) WHERE path LIKE '%/m6.js'")
def snippet_of_file(spark, d):
    """One member of the classes of one file."""
    return K.snippets(P.files(spark, d), "/m6.js:C6.run").select("path", "qualified")


@query(P.expected("at, scope", {0: [(11, "f~k~"), (17, "C~k~ > run")], 1: [(16, "K~k~ > find~k~")], 2: [(11, "C~k~ > load")], 4: [(9, "S~k~ > show~k~")], 5: [(9, "M~k~ > C~k~ > go~k~")]}))
def scopes(spark, d):
    """What stands around a line, outermost first."""
    at = {"js": (1, 11, 17), "ts": (16,), "py": (11,), "rs": (9,), "rb": (9,), "go": (1,)}
    picks = F.element_at(F.create_map(*(x for k, v in at.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), X.extension(F.col("path")))
    asked = P.files(spark, d).select("path", F.explode(picks).alias("at"))
    return K.scope_at(_scan(spark, d, "symbols"), asked)


@query(P.expected("spec, line, kind, bindings", P.IMPORTS))
def imports(spark, d):
    return _scan(spark, d, "imports")


@query(P.expected("name, line, kind", P.EXPORTS))
def exports(spark, d):
    return _scan(spark, d, "exports")


@query(P.expected("caller, callee, line", P.CALLS))
def call_graph(spark, d):
    return _scan(spark, d, "calls")


@query(P.expected("kind, name, exported, line, end_line, definition", P.TYPES))
def type_blocks(spark, d):
    return _scan(spark, d, "types")


@query(P.expected("name, line, doc, tags", P.DOCS))
def doc_comments(spark, d):
    return _scan(spark, d, "docs").select("path", "name", "line", "doc", "tags")


@query(P.expected("method, route, line, handler, framework", P.ENDPOINTS))
def endpoints(spark, d):
    return _scan(spark, d, "endpoints")


@query(P.expected("name, line, props, hooks, state, children", P.COMPONENTS))
def components(spark, d):
    return _scan(spark, d, "components")


@query(f"SELECT kind, type, count(*) AS n, count(DISTINCT path) AS files FROM ({P.expected('kind, type, line', P.ERRORS)}) GROUP BY kind, type")
def errors_by_type(spark, d):
    return _scan(spark, d, "errors").groupBy("kind", "type").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query(f"SELECT path, count(*) FILTER (kind = 'throw') AS throws, count(*) FILTER (kind = 'catch') AS catches FROM ({P.expected('kind, type, line', P.ERRORS)}) GROUP BY path")
def errors_by_file(spark, d):
    return _scan(spark, d, "errors").groupBy("path").agg(F.count(F.when(F.col("kind") == "throw", 1)).alias("throws"), F.count(F.when(F.col("kind") == "catch", 1)).alias("catches"))


def _lines(spark, d, tests=False):
    return lines(P.files(spark, d, tests), "path", "content")


def _marks(spark, d):
    found = _lines(spark, d).where(C.marker_line(F.col("line"))).withColumn("m", C.marker(F.col("line"))).where("m is not null")
    return found.select("path", "pos", "m.type", "m.message", "m.author", "m.priority")


_MARKS = f"SELECT path, line::BIGINT AS pos, type, message, author, CASE type WHEN 'FIXME' THEN 1 ELSE 2 END AS priority FROM ({P.expected('type, message, author, line', P.TODOS)})"


@query(_MARKS)
def todo_scan(spark, d):
    return _marks(spark, d)


@query(f"SELECT type, count(*) AS n, min(priority) AS priority FROM ({_MARKS}) GROUP BY type")
def todo_by_type(spark, d):
    return R.todo_summary(_marks(spark, d), "type")


@query(f"SELECT path, count(*) AS n, min(priority) AS priority FROM ({_MARKS}) GROUP BY path")
def todo_by_file(spark, d):
    return R.todo_summary(_marks(spark, d), "path")


_ENTRIES = {
    0: [("exports", "Named export", 8), ("exports", "Named export", 15), ("routes", "Express routes", 23)],
    1: [("exports", "Named export", 8), ("exports", "Named export", 13), ("exports", "Named export", 19), ("routes", "Decorator routes", 14)],
}


@query(f"SELECT path, line::BIGINT AS pos, kind, what FROM ({P.expected('kind, what, line', _ENTRIES)})")
def entry_points(spark, d):
    return R.entry_points(_lines(spark, d).where("path rlike '[.](js|ts)$'"))


@query(P.expected("pos, kind", {0: [(8, "definition"), (17, "usage"), (23, "usage")], 1: [(8, "definition")], 2: [(11, "usage"), (13, "definition")], 3: [(14, "usage"), (17, "definition")], 4: [(9, "definition"), (12, "usage")], 5: [(9, "usage"), (13, "definition")]}).replace("::INT AS pos", "::BIGINT AS pos"))
def usage_kinds(spark, d):
    """How each line uses the name that its file defines."""
    name = F.concat(F.lit("f"), F.regexp_extract("path", "/m([0-9]+)[.]", 1))
    rows = _lines(spark, d).withColumn("name", name).where("regexp_like(line, concat('(^|[^A-Za-z0-9_])', name, '($|[^A-Za-z0-9_])'))")
    return rows.select("path", "pos", R.usage_kind(F.col("line"), F.col("path")).alias("kind"))


@query(f"SELECT {P.path_sql()} AS path, [4, 1, 1, 1, 1, 2][k % 6 + 1] AS cyclomatic, [6, 0, 0, 0, 0, 0][k % 6 + 1] AS cognitive, 'simple' AS rating FROM {P._ROWS}")
def complexity(spark, d):
    """Complexity of whole files."""
    bare = F.regexp_replace("content", "(?m)^[ \\t]*(#|///?) .*$", "")
    n = C.cyclomatic(bare)
    return P.files(spark, d).select("path", n.alias("cyclomatic"), C.cognitive(bare).alias("cognitive"), C.rating(n).alias("rating"))


@query(f"SELECT path, count(*) AS functions, [1.5, 1.0, 1.3, 1.0, 1.0, 1.0][(regexp_extract(path, 'm([0-9]+)', 1)::INT) % 6 + 1]::DOUBLE AS mean FROM ({P.expected('name, line, end_line', _FUNCTIONS)}) WHERE path LIKE '%.go' OR path LIKE '%.rs' GROUP BY path")
def complexity_by_file(spark, d):
    """Functions of each file and their mean complexity, to one digit."""
    found = _scan(spark, d, "functions").where("path rlike '[.](go|rs)$'").withColumn("n", C.cyclomatic(F.col("body")))
    return found.groupBy("path").agg(F.count("*").alias("functions"), F.round(F.avg("n"), 1).alias("mean"))


_LINKS = f"(SELECT {P.path_sql('k')} AS src, {P.path_sql('h')} AS dst, k, h FROM {P._ROWS} WHERE h <> k)"


def _edges(spark, d, tests=False):
    files = P.files(spark, d, tests)
    return G.edges(G.resolve(K.scan(files, "imports"), files))


@query(f"SELECT src, dst, CASE k % 6 WHEN 5 THEN 'relative' ELSE 'static' END AS kind FROM {_LINKS}")
def import_graph(spark, d):
    """Resolved imports between files."""
    return _edges(spark, d)


@query(f"""SELECT path, spec, CASE WHEN spec LIKE '%m%' || h OR spec LIKE '%::m' || h THEN 'local' WHEN spec IN ('fs', 'os') THEN 'builtin' ELSE 'package' END AS module
  FROM ({' UNION ALL '.join(f"SELECT {P.path_sql()} AS path, {P.fill_sql(x[0])} AS spec, h FROM {P._ROWS} WHERE k % 6 = {kind}" for kind, facts in P.IMPORTS.items() for x in facts)}) WHERE NOT spec LIKE 'inner%'""")
def import_kinds(spark, d):
    files = P.files(spark, d)
    return G.resolve(K.scan(files, "imports"), files).where("spec not like 'inner%'").select("path", "spec", "module")


@query(f"SELECT {P.path_sql()} AS path, spec, shown FROM (SELECT *, 'lib' || e AS spec, '*' AS shown FROM {P._ROWS} WHERE k % 6 = 0 UNION ALL SELECT *, 'src/d' || g || '/m' || h, 'm' FROM {P._ROWS} WHERE k % 6 = 3 UNION ALL SELECT *, 'crate::d' || g || '::m' || h, 'fmt, io' FROM {P._ROWS} WHERE k % 6 = 4)")
def bindings_shown(spark, d):
    found = _scan(spark, d, "imports").where("spec like 'lib%' or spec like 'src/%' or spec like 'crate%'")
    return found.select("path", "spec", G.shown_bindings(F.col("bindings"), F.col("kind")).alias("shown"))


@query(f"SELECT dst, depth::INT AS depth, src AS path FROM (SELECT dst, src, 0 AS depth FROM {_LINKS}) ORDER BY dst, depth, path LIMIT 50")
def importers_ranked(spark, d):
    """Direct importers by file, depth and path."""
    return _edges(spark, d).select("dst", F.lit(0).alias("depth"), F.col("src").alias("path")).orderBy("dst", "depth", "path").limit(50)


@query(f"""WITH l AS (SELECT * FROM {_LINKS}) SELECT a.src AS root, a.dst AS node, a.src AS parent, 1 AS depth, false AS circular FROM l a WHERE a.k % 7 = 0
  UNION ALL SELECT a.src, b.dst, a.dst, 2, false FROM l a JOIN l b ON b.k = a.h WHERE a.k % 7 = 0""")
def dependency_tree(spark, d):
    """What every seventh file imports, two levels deep."""
    edges = G.materialize(_edges(spark, d), "edges")  # the roots and the tree read them
    roots = edges.select(F.col("src").alias("node")).distinct().where("cast(regexp_extract(node, 'm([0-9]+)', 1) as int) % 7 = 0")
    return G.dependency_tree(edges, roots, 2)


_TESTS = f"""SELECT {P.path_sql()} AS source, 'tests/m' || k || '.test.js' AS test, 'name' AS how FROM {P._ROWS} WHERE k % 12 = 0
  UNION ALL SELECT {P.path_sql()}, 'src/d' || d || '/m' || k || '.test.ts', 'beside' FROM {P._ROWS} WHERE k % 30 = 1"""


@query(_TESTS)
def test_map(spark, d):
    """Tests of each file, and how they were found."""
    return G.tests_of(P.files(spark, d, True), _edges(spark, d, True))


@query(f"""SELECT path, name, (name = 'f' || k AND k % 12 = 0) OR (name IN ('f' || k, 'K' || k) AND k % 30 = 1) AS tested FROM (SELECT *, regexp_extract(path, 'm([0-9]+)', 1)::BIGINT AS k FROM ({P.expected('name, line, kind', P.EXPORTS)}) WHERE path LIKE '%.js' OR path LIKE '%.ts')""")
def tested_exports(spark, d):
    files = P.files(spark, d, True)
    own = _scan(spark, d, "exports").where("path rlike '[.](js|ts)$'")
    return G.tested_exports(own, G.tests_of(files, _edges(spark, d, True)), files)


@query(f"""WITH e AS (SELECT *, regexp_extract(path, 'm([0-9]+)', 1)::BIGINT AS k FROM ({P.expected('name, line, kind', P.EXPORTS)})),
  i AS (SELECT h, CASE k % 6 WHEN 0 THEN 'f' || h WHEN 1 THEN 'T' || h ELSE '' END AS name FROM {P._ROWS} WHERE h <> k UNION ALL SELECT k, 'f' || k FROM {P._ROWS} WHERE k % 12 = 0 OR k % 30 = 1 UNION ALL SELECT k, 'K' || k FROM {P._ROWS} WHERE k % 30 = 1)
  SELECT path, name FROM e ANTI JOIN i ON e.k = i.h AND e.name = i.name WHERE NOT (length(name) <= 3 OR regexp_matches(name, '^[A-Z]'))""")
def unused_exports(spark, d):
    """Exports that nothing imports, of names that are long and lower-case: those need no second look."""
    files = P.files(spark, d, True)
    found = G.unused_exports(_scan(spark, d, "exports"), G.resolve(K.scan(files, "imports"), files), files)
    return found.where("length(name) > 3 and not name rlike '^[A-Z]'")


@query(f"SELECT {P.path_sql()} AS path FROM {P._ROWS} p WHERE NOT EXISTS (SELECT 1 FROM {P._ROWS} q WHERE q.h = p.k AND q.k <> p.k) AND k % 6 <> 5 AND k % 12 <> 0 AND k % 30 <> 1")
def unreferenced_files(spark, d):
    """Files that nothing imports or speaks of (Ruby ones count as entries)."""
    return G.unreferenced(P.files(spark, d, True), _edges(spark, d, True), F.col("path").endswith(".rb"))


@query(f"""WITH p AS (SELECT {P.path_sql()} AS path, d, k FROM {P._ROWS}), n AS (SELECT d, path, row_number() OVER (PARTITION BY d ORDER BY path) AS nth FROM p),
  s AS (SELECT p.path, n.path AS related, row_number() OVER (PARTITION BY p.path ORDER BY n.path) AS nth FROM p JOIN n ON p.d = n.d AND n.nth <= 6 AND n.path <> p.path)
  SELECT source AS path, test AS related, 'test' AS how FROM ({_TESTS}) UNION ALL SELECT dst, src, 'importer' FROM {_LINKS} UNION ALL SELECT path, related, 'sibling' FROM s WHERE nth <= 5""")
def related_files(spark, d):
    files, edges = P.files(spark, d, True), _edges(spark, d, True)
    return G.related(files, edges, G.tests_of(files, edges))


@query(f"""SELECT p.path, risk::INT AS risk, advice FROM (SELECT {P.path_sql()} AS path, k, (SELECT count(*) FROM {P._ROWS} q WHERE q.h = p.k AND q.k <> p.k) AS n, CASE WHEN k % 12 = 0 OR k % 30 = 1 THEN 1 ELSE 0 END AS tests FROM {P._ROWS} p) p,
  LATERAL (SELECT floor((CASE WHEN n = 0 THEN 1 WHEN n <= 2 THEN 2 WHEN n <= 5 THEN 4 ELSE 7 END) * 0.4 + 0.3 + (CASE WHEN tests = 0 THEN 8 ELSE 5 END) * 0.3 + 0.5) AS risk, CASE WHEN tests = 0 THEN 'cover it with tests first' ELSE 'add test cases' END AS advice)""")
def risk_score(spark, d):
    """Risk of changing each file, from the import graph, its complexity and its tests."""
    files, edges = P.files(spark, d, True), _edges(spark, d, True)
    tests = G.tests_of(files, edges).groupBy(F.col("source").alias("path")).agg(F.count("*").alias("tests"))
    importers = edges.where(~G.is_test(F.col("src"))).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))
    rows = P.files(spark, d).select("path", C.cyclomatic(F.regexp_replace("content", "(?m)^[ \\t]*(#|///?) .*$", "")).alias("complexity")).join(sorted_side(tests), "path", "left").join(sorted_side(importers), "path", "left").fillna(0, ["tests", "importers"])
    columns = [F.col("importers"), F.col("complexity"), F.col("tests"), F.col("tests")]
    return rows.select("path", C.risk(*columns).alias("risk"), C.risk_advice(*columns).alias("advice"))


@query(f"""SELECT path, CASE WHEN path LIKE '%test%' THEN 'test' ELSE 'source' END AS category, CASE WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.rs' THEN 'rust' ELSE 'ruby' END AS language
  FROM (SELECT {P.path_sql()} AS path FROM {P._ROWS} UNION ALL SELECT test FROM ({_TESTS}))""")
def file_classes(spark, d):
    path = F.col("path")
    return P.files(spark, d, True).select("path", C.file_category(path).alias("category"), C.language(path).alias("language")).where(~C.skipped(X.basename(path)) & ~C.sensitive(path))


@query(f"SELECT {P.path_sql()} AS path FROM {P._ROWS}")
def source_files(spark, d):
    """Code files that are no tests."""
    return R.source_files(P.files(spark, d, True)).select("path")


@query(f"SELECT path, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind <> 'class') AS others FROM ({P.expected('kind, name, line, end_line, parent', P.SYMBOLS)}) GROUP BY path")
def structure(spark, d):
    """Composite: what each file declares."""
    return _scan(spark, d, "symbols").groupBy("path").agg(F.count(F.when(F.col("kind") == "class", 1)).alias("classes"), F.count(F.when(F.col("kind") != "class", 1)).alias("others"))


@query(f"""SELECT p.path, s.symbols, i.imports, coalesce(n.importers, 0) AS importers FROM (SELECT {P.path_sql()} AS path FROM {P._ROWS}) p JOIN (SELECT path, count(*) AS symbols FROM ({P.expected('kind, name, line, end_line, parent', P.SYMBOLS)}) GROUP BY path) s USING (path)
  JOIN (SELECT path, count(*) AS imports FROM ({P.expected('spec, line, kind, bindings', P.IMPORTS)}) GROUP BY path) i USING (path) LEFT JOIN (SELECT dst AS path, count(*) AS importers FROM {_LINKS} GROUP BY dst) n USING (path)""")
def analyze(spark, d):
    """Composite: symbols, imports and importers of each file."""
    symbols_ = K.counted(_scan(spark, d, "symbols"))
    imports_ = _scan(spark, d, "imports").groupBy("path").agg(F.count("*").alias("imports"))
    importers = _edges(spark, d).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))
    return symbols_.join(sorted_side(imports_), "path", "left").join(sorted_side(importers), "path", "left").fillna(0, ["imports", "importers"])


@query(f"""SELECT check_name, n, CASE WHEN check_name = 'secrets' AND n > 0 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT 'secrets' AS check_name, 0::BIGINT AS n UNION ALL SELECT 'todos', count(*) FROM ({_MARKS}) UNION ALL SELECT 'cycles', 0)""")
def guard(spark, d):
    """Composite: the checks of a project, each with its finds and its verdict."""
    found = {"secrets": _lines(spark, d).where("line rlike 'token = \"[0-9a-f]{40}\"'"), "todos": _marks(spark, d), "cycles": G.cycle_sizes(_edges(spark, d))}
    return R.verdicts({name: (rows, "fail" if name == "secrets" else "warn") for name, rows in found.items()})


_BODIES = {0: [("f~k~", 'if (a && b) { return f~h~(a); } return "}{" + fs;'), ("run", 'try { return f~k~(x); } catch (e) { throw new E~e~Error("x"); }'), ("hidden~k~", "return lib.go(x, { a: 1, b: 2 });")], 3: [("Run~k~", "return f~k~(a)"), ("f~k~", 'fmt.Println("}", ~s~) return m.F~h~(a)')]}
_NORMAL = P.expected("name, body", _BODIES)
_TOKENS = "len(regexp_extract_all(body, '[A-Za-z_$][A-Za-z0-9_$]*|[^ A-Za-z_$]'))"


def _bodies(spark, d):
    found = _scan(spark, d, "functions").where("path rlike '[.](js|go)$'").select("path", "name", X.normal_body(F.col("body")).alias("body"))
    return found.withColumn("tokens", X.code_tokens(F.col("body")))


@query(f"SELECT substr(sha1(body), 1, 12) AS key, count(*) AS n, min(path) AS first_member, max({_TOKENS})::BIGINT AS tokens FROM ({_NORMAL}) WHERE {_TOKENS} >= 12 GROUP BY 1 HAVING count(*) >= 2")
def function_copies(spark, d):
    """Function bodies that occur twice or more, of 12 tokens at least."""
    rows = _bodies(spark, d).where("tokens >= 12")
    return rows.groupBy(X.digest(F.col("body")).alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("first_member"), F.max("tokens").alias("tokens")).where("n >= 2")


_SHAPES = {0: ['if (_ && _) { return _(_); } return "}{" + _;', 'try { return _(_); } catch (_) { throw new _("_"); }', "return _._(_, { _: 1, _: 2 });"], 3: ["return _(_)", '_._("}", ~s~) return _._(_)']}
_STRUCTURES = P.expected("name, body, shape", {kind: [(*x, shape) for x, shape in zip(facts, _SHAPES[kind], strict=True)] for kind, facts in _BODIES.items()})


@query(f"SELECT substr(sha1(shape), 1, 12) AS key, count(*) AS n, count(DISTINCT body) AS bodies, min(path) AS first_member FROM ({_STRUCTURES}) WHERE {_TOKENS} >= 12 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT body) > 1")
def function_shapes(spark, d):
    """Function bodies of one structure, keywords kept and other identifiers as underscores, that are not all equal."""
    from ..operators import duplicates as D

    return D.structural_groups(_bodies(spark, d).where("tokens >= 12"), X.digest(X.structural_body(F.col("body"))), F.col("body"), "path")
