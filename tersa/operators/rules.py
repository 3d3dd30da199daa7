"""Small report shapes: tables, suppression, lint and build output, notes, changed paths, suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .audit import START, api_like, api_options, build_or_test, http_url
from .classify import file_category, first_match, language, semver, skipped


def padded(rows: DataFrame, columns: list[str], within: str) -> DataFrame:
    """Columns padded to the widest value of their group; numbers on the right. Widths are aggregates, so no task holds a group."""
    kinds = dict(rows.dtypes)
    widths = rows.groupBy(within).agg(*(F.max(F.length(F.col(c).cast("string"))).alias(f"_{c}") for c in columns))
    shown = [(F.lpad if kinds[c] in ("int", "bigint", "double") else F.rpad)(F.col(c).cast("string"), F.col(f"_{c}"), F.lit(" ")).alias(f"{c}_shown") for c in columns]
    return rows.join(widths, within).select(within, *shown)


def absorbed(rows: DataFrame, category: str, name: str, absorbs: list[tuple[str, str]]) -> DataFrame:
    """Rows without those that another row's name absorbs: (absorber, absorbed)."""
    rules = rows.sparkSession.createDataFrame(absorbs, "absorber string, absorbed string")
    gone = rows.join(F.broadcast(rules), F.col(name) == F.col("absorber")).select(F.col("absorbed").alias(name)).distinct()
    return rows.join(gone, name, "left_anti").select(category, name)


#: Where a line of a linter names its rule, and what makes it a violation.
LINT_RULE = ("\\(([A-Za-z0-9_@/.:-]+)\\)\\s*$", "\\s+([A-Za-z0-9_@/-]+-[A-Za-z0-9_@/-]+)\\s*$")
VIOLATION = "(?i)error|warning|✕|✗"
#: Lines of a build, by the first pattern that hits; a mention of an error counts with a place only.
BUILD_LINES = (("error", "(?i)\\berror\\s*(TS|C|E|\\[E)\\d+"), ("error", "(?i)^\\s*error\\s*:"), ("warning", "(?i)\\bwarning\\b"))


def lint_rules(lines: DataFrame, line: str = "line", top: int = 10) -> DataFrame:
    """Rules by how often they are broken."""
    named = F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in LINT_RULE))
    return lines.where(F.col(line).rlike(VIOLATION)).select(named.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(top)


def build_line(line: Column) -> Column:
    """error, warning or null, by the forms of compilers."""
    placed = line.rlike("(?i)\\berror\\b") & line.rlike("\\S+:\\d+")
    return F.when(placed, "error").otherwise(first_match([(line.rlike(p), kind) for kind, p in BUILD_LINES]))


#: Sections of release notes, in order, with the prefixes that belong there.
SECTIONS = (("Features", "^(feat|add)"), ("Fixes", "^(fix|bug)"), ("Docs", "^docs?"), ("Other", ""))


def section(title: Column) -> Column:
    return first_match([(F.lower(title).rlike(pattern), name) for name, pattern in SECTIONS[:-1]], SECTIONS[-1][0])


#: What a changed path of a diff is, by the first pattern that hits its lower-case form.
DIFF_PATHS = (
    ("tests", "\\.test\\.|\\.spec\\.|__tests__"),
    ("components", "/components/|\\.tsx$"),
    ("hooks", "/hooks/|use"),
    ("store", "/store/|slice|reducer"),
    ("types", "/types/|\\.d\\.ts$"),
    ("manuscripts", "manuscripts|\\.json$"),
    ("config", "config|package\\.json|tsconfig"),
)
#: What a changed path of a pull request is, after tests and before sources.
PULL_PATHS = (
    ("docs", "(?i)\\.md$|\\.mdx$|\\.txt$|readme|changelog|license|docs?/"),
    ("assets", "(?i)\\.(png|jpg|jpeg|gif|svg|ico|webp|woff|woff2|ttf|eot|mp3|mp4|wav|webm|pdf|doc|docx)$"),
    ("config", "^\\.|(?i:config)|\\.json$|\\.ya?ml$|\\.toml$|\\.env|\\.lock$|package\\.json|tsconfig|eslint|prettier|webpack|vite|rollup"),
)


def diff_path(path: Column) -> Column:
    return first_match([(F.lower(path).rlike(p), kind) for kind, p in DIFF_PATHS], "other")


def pull_path(path: Column) -> Column:
    kind = file_category(path)
    return F.when(kind == "test", "test").otherwise(first_match([(path.rlike(p), k) for k, p in PULL_PATHS], F.when(kind == "source", "source").otherwise("other")))


def suggestion_score(name: Column, wanted: str) -> Column:
    """100 for the name itself, 80 for a prefix, 60 inside, 50 without punctuation, else 0."""
    lower, sought = F.lower(name), wanted.lower()
    bare, plain = F.regexp_replace(lower, "[^a-z0-9]", ""), "".join(c for c in sought if c.isalnum())
    return first_match([(lower == sought, 100), (lower.startswith(sought), 80), (lower.contains(sought), 60), (bare.contains(plain), 50)], F.lit(0))


def kept_lines(lines: DataFrame, file: str, pos: str, line: str, mark: str) -> DataFrame:
    """Lines without those that a keep mark, on them or on the comment line before, protects."""
    before = F.lag(line).over(W.partitionBy(file).orderBy(pos))
    protected = F.col(line).contains(mark) | (F.coalesce(before, F.lit("")).contains(mark) & F.coalesce(before, F.lit("")).rlike("^[ \\t]*(//|#)"))
    return lines.withColumn("protected", protected).where("not protected").drop("protected")


def capped(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The first rows of each key, and how many are left out."""
    nth, n = F.row_number().over(W.partitionBy(key).orderBy(order)), F.count("*").over(W.partitionBy(key))
    return rows.withColumn("nth", nth).withColumn("omitted", F.greatest(n - cap, F.lit(0)).cast("bigint")).where(F.col("nth") <= cap).drop("nth")


#: Commands by kind, and what output says of its command, of which two must hit.
COMMAND_KINDS = (
    ("test", "(?i)\\b(test|jest|vitest|mocha|pytest|rspec|phpunit|go\\s+test|cargo\\s+test|npm\\s+test|npx\\s+jest|npx\\s+vitest)\\b"),
    ("build", "(?i)\\b(build|compile|tsc|webpack|make|cargo\\s+build|go\\s+build|gcc|g\\+\\+|esbuild|rollup|vite\\s+build)\\b"),
    ("lint", "(?i)\\b(lint|eslint|prettier|pylint|flake8|clippy|golangci|biome|stylelint|tslint)\\b"),
)
OUTPUT_KINDS = {
    "test": ("(?i)\\d+\\s+(passing|passed|failed|failing)", "(?i)test\\s+suites?:", "(?i)tests?:\\s+\\d+", "(?i)test result:", "(?i)\\d+\\s+tests?\\s+(ran|completed|executed)", "PASS\\s+|FAIL\\s+"),
    "build": ("(?i)error\\s+(TS|C|E)\\d+", "(?i)\\bcompiled\\b", "(?i)BUILD\\s+(SUCCESS|FAILED)", "\\berror\\[E\\d+\\]", "(?i)webpack\\s+compiled", "(?i)built\\s+in\\s+\\d"),
    "lint": ("(?i)\\d+\\s+problems?", "(?i)\\d+\\s+errors?,\\s*\\d+\\s+warnings?", "(?i)\\d+\\s+warnings?\\s+found", "(?i)✖\\s+\\d+\\s+problems?"),
}


def command_kind(command: Column, output: Column) -> Column:
    """test, build, lint or generic: by the command, else by two hits or more in its output, the most first."""
    named = first_match([(command.rlike(p), kind) for kind, p in COMMAND_KINDS])
    hits = {k: sum((output.rlike(p).cast("int") for p in ps), F.lit(0)) for k, ps in OUTPUT_KINDS.items()}
    most = F.greatest(*hits.values())
    return F.coalesce(named, first_match([((n == most) & (n >= 2), k) for k, n in hits.items()], "generic"))


def since(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last days before the newest; without a time stamp none, and all if days isn't positive."""
    if days <= 0:
        return rows
    newest = rows.agg(F.max(ts).alias("newest"))
    return rows.join(F.broadcast(newest)).where(F.col(ts) >= F.col("newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("newest")


def dominant(rows: DataFrame, group: str, choice: str, share: float = 0.6) -> DataFrame:
    """Each group's most frequent choice with its share, and whether it dominates; the runner-up otherwise too."""
    counts = rows.groupBy(group, choice).agg(F.count("*").alias("n"))
    total, nth = F.sum("n").over(W.partitionBy(group)), F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), choice))
    ranked = counts.withColumn("share", F.round(F.col("n") / total, 4)).withColumn("nth", nth)
    best = F.first("share").over(W.partitionBy(group).orderBy("nth"))
    return ranked.withColumn("best", best).where((F.col("nth") == 1) | ((F.col("nth") == 2) & (F.col("best") < share))).select(group, choice, "n", "share", "nth")


#: What kinds of change a message speaks of.
CHANGE_KINDS = {"feature": "^feat|add|new", "fix": "^fix|bug|issue", "refactor": "refactor|cleanup", "docs": "^docs|readme|documentation", "test": "test", "chore": "^chore|deps|upgrade", "breaking": "breaking|!:"}


def change_flags(rows: DataFrame, key: str, title: Column) -> DataFrame:
    """What kinds of change each key holds."""
    return rows.groupBy(key).agg(*(F.bool_or(F.lower(title).rlike(p)).alias(k) for k, p in CHANGE_KINDS.items()))


def tool_of(command: Column) -> Column:
    """The tool that a command runs first, without folders and variables before it."""
    bare = F.regexp_replace(F.trim(command), "^([A-Z_]+=[^ ]* +)+", "")
    return F.regexp_extract(bare, "^(?:[^ ]*/)?([A-Za-z0-9_.-]+)", 1)


#: What a line does with a name, by the first pattern that hits; a test's lines are told by its path.
USAGE_LINES = (
    ("definition", "^\\s*(export\\s+)?((function|class|const|let|var|type|interface|enum)\\s|default\\s+(function|class))"),
    ("definition", "^\\s*(def|func)\\s"),
    ("import", "^\\s*(import|from|require)\\s"),
)


def usage_kind(line: Column, path: Column) -> Column:
    """definition, import, test or usage."""
    return F.coalesce(first_match([(line.rlike(p), kind) for kind, p in USAGE_LINES]), F.when(path.rlike("\\.(test|spec|e2e)\\.[^.]+$"), "test").otherwise("usage"))


#: What a way into a program looks like, by group, in order: (pattern over a line, what it is).
ENTRIES = {
    "main": (
        ("createApp\\(|new App\\(|express\\(\\)", "App initialization"),
        ("^\\s*app\\.listen\\(", "Server start"),
        ("ReactDOM\\.render|createRoot|hydrateRoot", "React entry"),
        ("main\\s*\\(|async function main", "Main function"),
    ),
    "routes": (
        ("app\\.(get|post|put|delete|patch)\\s*\\(", "Express routes"),
        ("router\\.(get|post|put|delete|patch)\\s*\\(", "Router routes"),
        ("fastify\\.(get|post|put|delete|patch)", "Fastify routes"),
        ("@(Get|Post|Put|Delete|Patch)\\(", "Decorator routes"),
        ("export (async )?function (GET|POST|PUT|DELETE|PATCH)", "Next.js API routes"),
    ),
    "handlers": (
        ("\\.on\\(['\"]\\w+['\"]", "Event listeners"),
        ("\\.addEventListener\\(", "DOM events"),
        ("onClick|onChange|onSubmit|onLoad|onError", "React handlers"),
        ("useEffect\\s*\\(", "React effects"),
        ("@Subscribe|@EventHandler|@Listener", "Event decorators"),
    ),
    "exports": (
        ("^export default", "Default export"),
        ("^export (async )?(function|class|const) \\w+", "Named export"),
        ("module\\.exports\\s*=", "CommonJS export"),
        ("exports\\.\\w+\\s*=", "Named CommonJS"),
    ),
    "cli": (
        ("#!/usr/bin/env node", "Node CLI shebang"),
        ("commander|yargs|meow|arg\\s*\\(", "CLI framework"),
        ("process\\.argv", "Argument parsing"),
        ("\\.command\\(", "Command definition"),
    ),
}
#: File names that are ways in by themselves.
ENTRY_FILES = "index.ts index.tsx index.js main.ts main.tsx app.ts app.tsx server.ts server.js".split()


def entry_points(lines: DataFrame, path: str = "path", pos: str = "pos", line: str = "line") -> DataFrame:
    """path, pos, kind, what: every pattern that a line hits; within a kind a line counts once, for its first pattern. Special files count at line 1."""
    hits = [F.when(F.col(line).rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("order"), F.lit(what).alias("what"))) for kind, rules in ENTRIES.items() for i, (p, what) in enumerate(rules)]
    rows = lines.select(path, pos, F.explode(F.array_compact(F.array(*hits))).alias("e")).groupBy(path, pos, "e.kind").agg(F.min_by("e.what", "e.order").alias("what"))
    special = lines.where((F.col(pos) == 1) & F.element_at(F.split(path, "/"), -1).isin(ENTRY_FILES)).select(path, pos, F.lit("file").alias("kind"), F.lit("special file").alias("what"))
    return rows.unionByName(special)


def routes(files: DataFrame, path: str = "path") -> DataFrame:
    """path, route, kind of files that a framework serves by their place: under app/ pages, route handlers and layouts; under pages/ pages and api handlers."""
    app, pages = F.regexp_extract(path, "(?:^|/)app/(.*)$", 1), F.regexp_extract(path, "(?:^|/)pages/(.*)[.](?:tsx|jsx|js|ts)$", 1)
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    kind = F.when(name.rlike("^page[.](tsx|jsx|js|ts)$"), "page").when(name.rlike("^route[.](tsx|ts|js)$"), "api").when(name.rlike("^layout[.](tsx|jsx|js)$"), "layout")

    def shown(parts: Column) -> Column:
        dynamic = lambda x: F.when(x.startswith("[..."), "*").when(x.rlike("^\\[.*\\]$"), F.concat(F.lit(":"), F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(x)
        return F.concat(F.lit("/"), F.array_join(F.transform(parts, dynamic), "/"))

    inside = F.split(F.regexp_replace(app, "/?[^/]*$", ""), "/")
    kept = F.filter(inside, lambda x: (x != "") & ~x.rlike("^[(].*[)]$"))
    hidden = F.exists(inside, lambda x: x.rlike("^[_.@]"))
    rest = F.filter(F.split(F.regexp_replace(pages, "(^|/)index$", ""), "/"), lambda x: x != "")
    by_app = files.where((app != "") & kind.isNotNull() & ~hidden).select(path, shown(kept).alias("route"), kind.alias("kind"))
    by_pages = files.where((pages != "") & ~F.element_at(F.split(path, "/"), -1).startswith("_")).select(path, shown(rest).alias("route"), F.when(pages.startswith("api/"), "api").otherwise("page").alias("kind"))
    return by_app.unionByName(by_pages)


#: What makes a line of output worth showing, in a run that failed and in one that didn't.
FAILED_LINE = "\\b(error|Error|ERROR|fatal|FATAL|panic|PANIC|exception|Exception|warn|Warn|WARN|warning|Warning|WARNING|fail|Fail|FAIL|invalid|Invalid|INVALID)\\b"
PASSED_LINE = "\\b(error|Error|ERROR|fatal|FATAL|panic|PANIC|exception|Exception)\\b"


def output_summary(lines: DataFrame, key: str, pos: str, line: str, failed: Column) -> DataFrame:
    """key, pos, part (all, head, diagnostic, tail) of the lines that a summary shows.

    Short outputs are shown whole: 150 lines, 250 of a failed run. Of longer ones the first and last 25 (40) lines,
    and between them the first 15 (25) that look like errors.
    """
    order = W.partitionBy(key).orderBy(pos)
    rows = lines.withColumn("_failed", failed).withColumn("_n", F.count("*").over(W.partitionBy(key))).withColumn("_at", F.row_number().over(order))
    ends, few = F.when(F.col("_failed"), 40).otherwise(25), F.when(F.col("_failed"), 25).otherwise(15)
    told = F.when(F.col("_failed"), F.col(line).rlike(FAILED_LINE)).otherwise(F.col(line).rlike(PASSED_LINE))
    part = F.when(F.col("_n") <= F.when(F.col("_failed"), 250).otherwise(150), "all").when(F.col("_at") <= ends, "head").when(F.col("_at") > F.col("_n") - ends, "tail").when(told, "diagnostic")
    parted = rows.withColumn("part", part).where(F.col("part").isNotNull())
    nth = F.row_number().over(W.partitionBy(key, "part").orderBy(pos))
    return parted.withColumn("_nth", nth).where((F.col("part") != "diagnostic") | (F.col("_nth") <= few)).select(key, pos, "part")


def diverse(matches: DataFrame, key: str, folder: str, file: str, kind: str, order: str, count: int, kinds: tuple[str, ...] = ("usage", "definition", "test", "type", "import")) -> DataFrame:
    """``matches`` with nth, the first ``count`` of each key: one of each folder, then of each further file, then of each further kind, then the rest; the kinds in their order first."""
    rank = first_match([(F.col(kind) == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    rows = matches.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(rank, order)))
    first = lambda *c: F.row_number().over(W.partitionBy(key, *c).orderBy("_at")) == 1
    one = rows.withColumn("_folder", first(folder))
    used = lambda flag, c: F.max(F.col(flag).cast("int")).over(W.partitionBy(key, c)) == 1
    two = one.withColumn("_file", ~used("_folder", file) & first(file)).withColumn("_early", F.col("_folder") | F.col("_file"))
    three = two.withColumn("_kind", ~used("_early", kind) & first(kind))
    turn = F.when(F.col("_folder"), 1).when(F.col("_file"), 2).when(F.col("_kind"), 3).otherwise(4)
    nth = F.row_number().over(W.partitionBy(key).orderBy(turn, "_at"))
    return three.withColumn("nth", nth).where(F.col("nth") <= count).select(*matches.columns, "nth")


def united(*found: DataFrame, key: list[str], order: str) -> DataFrame:
    """The union of finds, one for each key: that of the first ``order``."""
    every = reduce(DataFrame.unionByName, found)
    kept = [order, *(c for c in every.columns if c not in key and c != order)]
    one = every.groupBy(*key).agg(F.min(F.struct(*kept)).alias("x"))
    return one.select(*key, *(F.col("x")[c].alias(c) for c in kept))


#: Changed lines beyond which a file is read first.
LARGE_CHANGE = 100


def key_files(changes: DataFrame, path: str, lines: str, added: str, top: int = 10) -> DataFrame:
    """path, why, priority of the changed files to read first: large changes, then new files of a known language that are no tests."""
    large = changes.where(F.col(lines) > LARGE_CHANGE).select(path, F.format_string("%d lines changed", F.col(lines).cast("bigint")).alias("why"), F.lit(0).alias("priority"))
    new = changes.where(F.col(added) & language(F.col(path)).isNotNull() & ~F.col(path).rlike("test|spec")).select(path, F.lit("new file").alias("why"), F.lit(1).alias("priority"))
    return large.unionByName(new).orderBy("priority", path, "why").limit(top)


def todo_summary(marks: DataFrame, by: str) -> DataFrame:
    """Marks of each type or file, and the most urgent priority among them."""
    return marks.groupBy(by).agg(F.count("*").alias("n"), F.min("priority").alias("priority"))


def rewritten(command: Column, run: str = "run", browse: str = "browse") -> Column:
    """The command that should be run instead, its argument as a JSON string; null if none should."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, "\\\\", "\\\\\\\\"), '"', '\\\\"'), F.lit('"'))
    page = command.rlike(START + "curl ") & ~api_options(command) & (http_url(command) != "") & ~api_like(http_url(command))
    wanted = F.when(build_or_test(command), F.concat(F.lit(f"{run} "), quoted(command))).when(page, F.concat(F.lit(f"{browse} "), quoted(http_url(command))))
    return F.when((command != "") & ~command.rlike(f"^ *({run}|{browse})($| )"), wanted)


def rendered(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object, null fields included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def tail(lines: DataFrame, file: str, pos: str, n: int = 600) -> DataFrame:
    """The last lines of each file."""
    return lines.withColumn("back", F.row_number().over(W.partitionBy(file).orderBy(F.desc(pos)))).where(F.col("back") <= n).drop("back")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def internal(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages of the workspace with those that depend on them."""
    known = packages.select(F.col("name").alias("dep"))
    return deps.join(known, "dep", "left_semi").groupBy("dep").agg(F.sort_array(F.collect_set("name")).alias("depended_on_by"))


def source_files(files: DataFrame, path: str = "path", tests: bool = False) -> DataFrame:
    """Files of a known language that aren't passed over; without tests unless asked for."""
    known = files.where(language(F.col(path)).isNotNull() & ~skipped(F.element_at(F.split(path, "/"), -1)))
    return known if tests else known.where(file_category(F.col(path)) == "source")


def verdicts(found: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """check_name, n, verdict of each check: pass without finds, else what the check says then."""
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n", F.when(F.col("n") > 0, otherwise).otherwise("pass").alias("verdict")) for name, (rows, otherwise) in found.items()]
    return reduce(DataFrame.unionByName, counts)


def ranges(rows: DataFrame, key: list[str], number: str, step: int = 1) -> DataFrame:
    """key, ranges: the numbers of each key, those that follow each other by ``step`` as first-last. A key's numbers are its text, so they should be as many as a text holds."""
    island = F.col(number) - step * F.row_number().over(W.partitionBy(*key).orderBy(number))
    runs = rows.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"]), ", ").alias("ranges"))


def tool_usage(commands: DataFrame, command: str, samples: int = 3) -> DataFrame:
    """tool, n, samples: tools by how often they run, with their first commands in order; samples are cut down before they are gathered."""
    rows = commands.select(F.col(command).alias("_c"), tool_of(F.col(command)).alias("tool"))
    counts = rows.groupBy("tool").agg(F.count("*").alias("n"))
    first = rows.distinct().withColumn("_nth", F.row_number().over(W.partitionBy("tool").orderBy("_c"))).where(F.col("_nth") <= samples)
    shown = first.groupBy("tool").agg(F.sort_array(F.collect_list("_c")).alias("samples"))
    return counts.join(shown, "tool").orderBy(F.desc("n"), "tool")


def compact_command(command: Column, limit: int = 180) -> Column:
    """A command on one line, cut to ``limit`` characters."""
    flat = F.trim(F.regexp_replace(command, "[ \\t\\n\\r\\f]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def release_sections(changes: DataFrame, title: str, since_cutoff: Column) -> DataFrame:
    """section, n, place: changes since the cutoff, by section of release notes, in the sections' order."""
    rows = changes.where(since_cutoff).groupBy(section(F.col(title)).alias("section")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.array_position(F.array(*(F.lit(name) for name, _ in SECTIONS)), F.col("section")).cast("int"))


def folder_tree(files: DataFrame, path: str, size: str) -> DataFrame:
    """folder, depth, files, size, tokens: subtotals of every folder of a listing, the root as an empty name; each file counts in all folders above it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select(F.explode(above).alias("folder"), F.col(size).alias("_size"))
    sums = rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("_size").alias("size"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return sums.select("folder", depth.alias("depth"), "files", "size", F.ceil(F.col("size") / 4).cast("bigint").alias("tokens"))


def workspace_packages(files: DataFrame, patterns: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """path, name of the packages of a workspace: manifests in folders that a pattern (a glob) matches."""
    from ..functions.text import glob_pattern

    folder = F.regexp_replace(path, "/?package[.]json$", "")
    inside = reduce(lambda a, b: a | b, (folder.rlike(glob_pattern(p.rstrip("/"))) for p in patterns))
    return files.where(F.col(path).rlike("(^|/)package[.]json$") & inside).select(folder.alias("path"), F.get_json_object(content, "$.name").alias("name")).where("name is not null")


def notes_since(tags: DataFrame, changes: DataFrame, target: str, tag: str = "tag", at: str = "at", title: str = "title") -> DataFrame:
    """section, n, place: release notes of a tag: changes later than the highest version below it, by section."""
    key = semver(F.col(tag))
    before = tags.where(key < semver(F.lit(target))).agg(F.max_by(at, key).alias("_cutoff"))
    rows = changes.join(F.broadcast(before)).where(F.col("_cutoff").isNull() | (F.col(at) > F.col("_cutoff")))  # one row
    return release_sections(rows, title, F.lit(True))
