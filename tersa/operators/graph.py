"""Import graphs as edge tables (src imports dst)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import walks
from .tables import materialize, release, sorted_side

#: Edges that one task walks without being split further.
TASK = 1 << 20


def importers(edges: DataFrame) -> DataFrame:
    """dst, how many import it, and the first; self-edges don't count."""
    return edges.where("src <> dst").groupBy("dst").agg(F.countDistinct("src").alias("importers"), F.min("src").alias("first_importer"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth of all that import the seeds (column node), directly or through others, up to ``depth`` steps. A round is one join; only new nodes go on."""
    edges = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "front")
    front = seen
    for step in range(1, depth + 1):
        found = front.join(edges, front["node"] == edges["dst"]).select(F.col("src").alias("node")).distinct()
        front = materialize(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), "front")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def cyclic(edges: DataFrame, task: int = TASK) -> tuple[DataFrame, int]:
    """Those of the distinct ``edges`` that may lie on a cycle, and how many: a round peels off the nodes that nothing leads to and those that lead nowhere.

    Rounds end when one task can walk what is left, or when they hardly peel any more (a long chain sheds two edges a round).
    """
    now, n = edges, edges.count()
    while n > task:
        sources, targets = now.select(F.col("src").alias("node")).distinct(), now.select(F.col("dst").alias("node")).distinct()
        kept = materialize(now.join(sorted_side(targets), now["src"] == targets["node"], "left_semi").join(sorted_side(sources), F.col("dst") == sources["node"], "left_semi"), "cyclic")
        release(now)
        now, before, n = kept, n, kept.count()
        if before - n <= before // 16:
            break
    return now, n


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links`` (u, v), root the smallest node that it hangs together with: large-star and small-star rounds until nothing changes."""
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before, after = None, now.agg(state).first()[0]
    while before != after:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(sorted_side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(sorted_side(small), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_ = materialize(joined.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(now)
        release(large)
        now, before, after = next_, after, next_.agg(state).first()[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def walked(edges: DataFrame, found, columns: str, task: int = TASK) -> tuple[DataFrame, DataFrame]:
    """What ``found`` (ids, line, depth: a row) makes of every edge that closes a cycle, and the names (id, node) of the nodes' numbers, which have the same order.

    A depth-first walk with three colours: each strong component from its smallest node, what a node leads to in the
    order of names, one cycle for every edge back to an open node, whatever its length. Such a cycle holds one edge back
    and otherwise edges of the walk's tree, so none occurs twice. Nodes that hang together are walked in one task.
    """
    core, n = cyclic(materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges"), task)
    names = core.select(F.explode(F.array("src", "dst")).alias("node")).distinct().orderBy("node")
    names = materialize(names.select(F.monotonically_increasing_id().alias("id"), "node"), "names")
    links = core.join(sorted_side(names.select(F.col("id").alias("u"), F.col("node").alias("src"))), "src").join(sorted_side(names.select(F.col("id").alias("v"), F.col("node").alias("dst"))), "dst").select("u", "v")
    if n > task:
        links = materialize(links, "links")
        together = components(links).select(F.col("node").alias("u"), F.pmod(F.xxhash64("root"), F.lit(-(-n // task))).alias("part"))
        links = links.join(sorted_side(together), "u")
    else:
        links = links.withColumn("part", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate(x) for x in zip(*((np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches), strict=True))
        ids, first, to = walks.indexed(u, v)
        rows, size = [], 0
        for line, depth in walks.closing(*walks.inside(first, to)):
            rows.append(found(ids, line, depth))
            size += sum(x.size for x in rows[-1] if isinstance(x, np.ndarray)) + 1
            if size >= 1 << 18:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return links.select("u", "v", "part").groupBy("part").applyInArrow(run, columns), names


def cycle_sizes(edges: DataFrame, task: int = TASK) -> DataFrame:
    """nodes: how many nodes each cycle of a walk (``walked``) has, a row a cycle. Paths aren't listed, as they may be far longer than the edges."""
    return walked(edges, lambda ids, line, depth: (len(line) - depth,), "nodes long", task)[0]


def walk_cycles(edges: DataFrame, task: int = TASK) -> DataFrame:
    """The cycles of a walk (``walked``), of any length, each from its smallest node: path (array)."""

    def found(ids, line, depth):
        path = line[depth:]
        least = path.index(min(path))
        return int(ids[line[-1]]), int(ids[line[depth]]), ids[path[least:] + path[:least]]

    rows, names = walked(edges, found, "u long, v long, path array<long>", task)
    steps = rows.select("u", "v", F.posexplode("path").alias("pos", "id")).join(sorted_side(names), "id")
    return steps.groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("steps")).select(F.col("steps.node").alias("path"))


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """All simple cycles of up to ``length`` nodes, each once and from its smallest node: path (array). Longer ones need ``walk_cycles``."""
    plain = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    # a node that nothing leads to, or that leads nowhere, is in no cycle, so hubs lose most of their edges first
    sources, targets = plain.select(F.col("src").alias("node")).distinct(), plain.select(F.col("dst").alias("node")).distinct()
    inner = materialize(sources.join(sorted_side(targets), "node"), "inner")
    edges = materialize(plain.join(sorted_side(inner), plain["src"] == inner["node"], "left_semi").join(sorted_side(inner), F.col("dst") == inner["node"], "left_semi"), "edges")
    paths = edges.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    found = []
    for n in range(2, length + 1):
        closed = paths.join(sorted_side(edges), (paths["last"] == edges["src"]) & (paths["first"] == edges["dst"]), "left_semi")
        found.append(closed.select("path"))
        if n < length:
            longer = paths.join(sorted_side(edges), paths["last"] == edges["src"]).where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst")))
            paths = longer.select(F.concat("path", F.array("dst")).alias("path"), "first", F.col("dst").alias("last"))
    return reduce(DataFrame.unionByName, found)


#: Endings that an import may leave out, in the order they are tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rb", ".go", ".rs", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    step = lambda done, x: F.when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``imports`` (path, spec, ...) with resolved, the file (column path of ``files``) that a relative, aliased or dotted import means, and module, its kind.

    A file is known by its path without each ending that it has, three names at most; the first of ENDINGS wins, so a name means one file.
    """
    spec = F.col("spec")
    for prefix, place in (aliases or {}).items():
        spec = F.when(F.col("spec").startswith(prefix), F.concat(F.lit(place), F.substr(F.col("spec"), F.lit(len(prefix) + 1)))).otherwise(spec)
    relative = F.col("spec").rlike("^[.]{1,2}(/|$)")
    dotted = F.regexp_replace(F.regexp_replace(spec, "^crate::", "src/"), "::|[.]", "/")
    base = F.when(relative, normal_path(F.concat(folder(F.col("path")), F.lit("/"), spec))).when(F.col("lang").isin("python", "rust"), dotted).otherwise(spec)
    numbered = imports.withColumn("_base", base).withColumn("_bare", F.regexp_replace("_base", "[.](m?js|jsx|tsx?)$", ""))
    short = lambda e: F.substr("path", F.lit(1), F.length("path") - len(e))
    names = F.array(*(F.when(F.col("path").endswith(e), F.struct(F.lit(i).alias("order"), short(e).alias("name"))) for i, e in enumerate(ENDINGS)))
    known = files.where("path is not null").select("path", F.explode(F.array_compact(names)).alias("t")).groupBy("t.name").agg(F.min_by("path", "t.order").alias("file"))
    whole, rest = known.select(F.col("name").alias("_base"), F.col("file").alias("_whole")), known.select(F.col("name").alias("_bare"), F.col("file").alias("_rest"))
    out = numbered.join(sorted_side(whole), "_base", "left").join(sorted_side(rest), "_bare", "left").select(*imports.columns, F.coalesce("_whole", "_rest").alias("resolved"))
    return out.withColumn("module", import_kind(F.col("spec"), F.col("resolved")))


def edges(resolved: DataFrame) -> DataFrame:
    """src, dst, kind of the resolved imports; a file's first import of another decides its kind."""
    found = resolved.where(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("path")))
    return found.groupBy(F.col("path").alias("src"), F.col("resolved").alias("dst")).agg(F.min_by("kind", F.struct("line", "kind")).alias("kind"))


def dependency_tree(edges_: DataFrame, roots: DataFrame, depth: int = 2, cap: int = 50) -> DataFrame:
    """root, node, parent, depth, circular: what the roots (column node) import, level by level; a node is listed once a root, below the parent of smallest name.

    ``cap`` nodes a root at most are listed; an import of a node that is listed already is circular if that is one of its own ancestors.
    """
    plain = materialize(edges_.where("src <> dst").select("src", "dst").distinct(), "edges")
    front = materialize(roots.select(F.col("node").alias("root"), "node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(False).alias("circular"), F.array("node").alias("line")), "front")
    seen = front
    for step in range(1, depth + 1):
        found = front.where("not circular").join(sorted_side(plain), front["node"] == plain["src"]).select("root", F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(step).alias("depth"), F.array_contains("line", F.col("dst")).alias("circular"), F.concat("line", F.array("dst")).alias("line"))
        one = found.groupBy("root", "node").agg(F.min(F.struct("circular", "parent", "depth", "line")).alias("x")).select("root", "node", "x.parent", "x.depth", "x.circular", "x.line")
        fresh = one.where("not circular").join(sorted_side(seen.select("root", "node")), ["root", "node"], "left_anti").unionByName(one.where("circular"))
        nth = F.row_number().over(W.partitionBy("root").orderBy("parent", "node"))
        listed = seen.groupBy("root").agg(F.sum((F.col("depth") > 0).cast("int")).alias("listed"))
        front = materialize(fresh.withColumn("nth", nth).join(sorted_side(listed), "root").where(F.col("nth") + F.col("listed") <= cap).drop("nth", "listed"), "front")
        seen = seen.unionByName(front)
    return seen.drop("line").where("depth > 0")


def stem(path: Column) -> Column:
    """A file's name without folder and last ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.][^.]*$", "")


def is_test(path: Column) -> Column:
    return path.rlike("[.](test|spec)[.]|_test[.](go|py|rb)$|(^|/)test_[^/]*[.]py$|_spec[.]rb$") | path.rlike("(^|/)(test|tests|spec|__tests__|e2e)/")


def tested_stem(path: Column) -> Column:
    """The stem of the file that a test's name speaks of."""
    return F.regexp_replace(F.regexp_replace(stem(path), "[.](test|spec)$|_(test|spec)$", ""), "^test_", "")


def tests_of(files: DataFrame, edges_: DataFrame) -> DataFrame:
    """source, test, how: tests beside their source (or in its __tests__), tests of its name anywhere, tests that import it; each pair once, the first way it was found."""
    tests = files.where(is_test(F.col("path"))).select(F.col("path").alias("test"), tested_stem(F.col("path")).alias("stem"))
    sources = files.where(~is_test(F.col("path"))).select(F.col("path").alias("source"), stem(F.col("path")).alias("stem"))
    named = sources.join(sorted_side(tests), "stem")
    beside = folder(F.col("source")) == F.regexp_replace(folder(F.col("test")), "/?__tests__$", "")
    by_name = named.select("source", "test", F.when(beside, 0).otherwise(1).alias("way"))
    importing = edges_.where(is_test(F.col("src")) & ~is_test(F.col("dst"))).select(F.col("dst").alias("source"), F.col("src").alias("test"), F.lit(2).alias("way"))
    ways = F.array(F.lit("beside"), F.lit("name"), F.lit("import"))
    return by_name.unionByName(importing).groupBy("source", "test").agg(F.element_at(ways, F.min("way") + 1).alias("how"))


def tested_exports(exports: DataFrame, tests: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, tested: whether a test of the file (``tests_of``) has the exported name as a word."""
    words = tests.join(sorted_side(files.select(F.col("path").alias("test"), "content")), "test").select(F.col("source").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name")).distinct()
    return exports.select("path", "name").distinct().join(sorted_side(words.withColumn("tested", F.lit(True))), ["path", "name"], "left").withColumn("tested", F.coalesce("tested", F.lit(False)))


def unused_exports(exports: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name of exports that no file imports by name. Where a file is imported whole, and for names that are short or capitalised, no other file may hold the word either."""
    named = imports.where(F.col("resolved").isNotNull()).select(F.col("resolved").alias("path"), F.explode("bindings").alias("name"))
    whole = named.where("name = '*'").select("path").distinct().withColumn("whole", F.lit(True))
    left = exports.where("name not in ('*', 'default')").select("path", "name").distinct().join(named, ["path", "name"], "left_anti").join(whole, "path", "left")
    doubtful = F.col("whole").isNotNull() | (F.length("name") <= 3) | F.col("name").rlike("^[A-Z]")
    words = files.select(F.col("path").alias("other"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name"))
    # how many files hold a word says whether another does, without listing pairs of files
    holders = words.join(left.where(doubtful).select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.countDistinct("other").alias("files"))
    own = words.join(left.where(doubtful).select(F.col("path").alias("other"), "name"), ["other", "name"], "left_semi").select(F.col("other").alias("path"), "name", F.lit(1).alias("own")).distinct()
    judged = left.join(holders, "name", "left").join(own, ["path", "name"], "left")
    elsewhere = F.coalesce("files", F.lit(0)) - F.coalesce("own", F.lit(0)) > 0
    return judged.where(~doubtful | ~elsewhere).select("path", "name")


def unreferenced(files: DataFrame, edges_: DataFrame, entries: Column) -> DataFrame:
    """path of files that no other imports, that are no entry (a condition on path) and no test, and whose stem no other file holds as a word."""
    alone = files.where(~entries & ~is_test(F.col("path"))).select("path").join(edges_.select(F.col("dst").alias("path")).distinct(), "path", "left_anti").withColumn("word", stem(F.col("path")))
    words = files.select(F.col("path").alias("other"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_$-]+"), F.lit(0)))).alias("word"))
    holders = words.join(alone.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"), F.min("other").alias("first"))
    held = alone.join(holders, "word").where((F.col("n") > 1) | (F.col("first") != F.col("path")))
    return alone.join(held.select("path"), "path", "left_anti").select("path")


def related(files: DataFrame, edges_: DataFrame, tests: DataFrame, siblings: int = 5) -> DataFrame:
    """path, related, how: a file's tests, type files, importers that are no tests, and its first siblings."""
    plain = files.where(~is_test(F.col("path"))).select("path", folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem"))
    by_test = tests.select(F.col("source").alias("path"), F.col("test").alias("related"), F.lit("test").alias("how"))
    kinds = plain.select("path", F.explode(F.array(F.concat_ws("/", F.nullif("folder", F.lit("")), F.concat("stem", F.lit(".types.ts"))), F.concat_ws("/", F.nullif("folder", F.lit("")), F.lit("types.ts")), F.concat_ws("/", F.nullif("folder", F.lit("")), F.lit("types"), F.concat("stem", F.lit(".ts"))))).alias("related")).where("path <> related")
    by_type = kinds.join(sorted_side(files.select(F.col("path").alias("related"))), "related", "left_semi").select("path", "related", F.lit("type").alias("how"))
    by_import = edges_.where(~is_test(F.col("src"))).select(F.col("dst").alias("path"), F.col("src").alias("related"), F.lit("importer").alias("how"))
    # the first few of a folder and one more serve all of its files
    first = plain.withColumn("nth", F.row_number().over(W.partitionBy("folder").orderBy("path"))).where(F.col("nth") <= siblings + 1).select("folder", F.col("path").alias("related"))
    beside = plain.join(first, "folder").where("path <> related").withColumn("nth", F.row_number().over(W.partitionBy("path").orderBy("related"))).where(F.col("nth") <= siblings)
    return by_test.unionByName(by_type).unionByName(by_import).unionByName(beside.select("path", "related", F.lit("sibling").alias("how")))


def shown_bindings(bindings: Column, kind: Column) -> Column:
    """What an import binds, as it is shown."""
    names = F.array_join(F.filter(bindings, lambda x: x != "*"), ", ")
    return F.when(kind == "side-effect", "(side effect)").when(kind == "dynamic", "(dynamic)").when(F.array_contains(bindings, "*") & (names == ""), "*").when(F.array_contains(bindings, "*"), F.concat(F.lit("*, "), names)).otherwise(names)


def import_kind(spec: Column, resolved: Column) -> Column:
    """builtin, asset, local, unresolved or package."""
    bare = F.element_at(F.split(F.regexp_replace(spec, "^node:", ""), "/"), 1)
    builtin = bare.isin("fs path os url util http https crypto stream events child_process assert buffer zlib net tls readline worker_threads".split())
    relative = spec.startswith(".") | spec.startswith("/")
    return F.when(builtin, "builtin").when(spec.rlike("(?i)[.](css|scss|less|svg|png|jpe?g|gif|webp|json|woff2?)$"), "asset").when(relative & resolved.isNull(), "unresolved").when(relative | (resolved.isNotNull() & ~resolved.contains("node_modules/")), "local").otherwise("package")


def containing(rows: DataFrame, file: str, line: str, definition: Column) -> DataFrame:
    """Each row with the nearest definition at or before it."""
    return rows.withColumn("container", F.last(definition, ignorenulls=True).over(W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, 0)))


def export_diff(old: DataFrame, new: DataFrame, name: str, signature: str) -> DataFrame:
    """name and added, removed or changed."""
    a = old.select(F.col(name).alias("name"), F.col(signature).alias("was"), F.lit(True).alias("old"))
    b = new.select(F.col(name).alias("name"), F.col(signature).alias("is"), F.lit(True).alias("new"))
    both = a.join(b, "name", "full_outer")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.withColumn("change", change).where("change is not null").select("name", "change")
