"""Rules and readers over lines, commands, subjects and reports that the rows of ``part`` spell out, and what they say by SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators import classify as C, code as K, history as H, readers as R, rules as U
from ..sources.tables import lines, read
from . import project as P
from .registry import query


def pick(templates: list[str], by: str = "k") -> Column:
    """The template that a row's key chooses, filled."""
    return F.coalesce(*(F.when(F.col(by) % len(templates) == i, P.fill(t)) for i, t in enumerate(templates)))


def pick_sql(templates: list, by: str = "k") -> str:
    return "CASE " + " ".join(f"WHEN {by} % {len(templates)} = {i} THEN {P.fill_sql(t)}" for i, t in enumerate(templates)) + " END"


def _text(spark, d, *templates: str) -> DataFrame:
    """doc, pos, line of a text per part."""
    rows = P.rows(spark, d).select(F.col("k").alias("doc"), pick(list(templates)).alias("text"))
    return lines(rows, "doc", "text")


@query(f"SELECT 'src/m' || k || '.js' AS source, 3::BIGINT AS found, (1 + (e > 0)::INT)::BIGINT AS hit, CASE WHEN e = 0 THEN [2, 3] ELSE [2] END AS missed, CASE WHEN e = 0 THEN 33.33::DOUBLE ELSE 66.67 END AS percent FROM {P._ROWS}")
def lcov_coverage(spark, d):
    rows = R.lcov(_text(spark, d, "SF:src/m~k~.js\nDA:1,1~s~\nDA:2,0\nDA:3,~e~\nend_of_record"))
    return rows.withColumn("percent", R.percent(F.col("hit"), F.col("found")))


@query(f"SELECT 'src/m' || k || '.js' AS source, 3 AS found, 1 + (e > 0)::INT AS hit FROM {P._ROWS}")
def statement_coverage(spark, d):
    rows = P.rows(spark, d).select(P.fill('{"src/m~k~.js":{"path":"x","s":{"0":1,"1":0,"2":~e~}}}').alias("report"))
    return R.statement_coverage(rows)


@query(f"SELECT 'src/m' || k || '.js' AS source, (100 + s)::BIGINT AS found, s::BIGINT AS hit FROM {P._ROWS}")
def summary_coverage(spark, d):
    rows = P.rows(spark, d).select(F.concat(F.lit('{"total":{"lines":{"total":9,"covered":9}},'), P.fill('"src/m~k~.js":{"lines":{"total":'), (F.col("s") + 100).cast("string"), P.fill(',"covered":~s~,"pct":1}}}')).alias("report"))
    return R.summary_coverage(rows)


@query(f"SELECT 'src/m' || k || '.js' AS path, (s + 1)::INT AS number, 'two ' || k AS text FROM {P._ROWS} UNION ALL SELECT 'src/m' || k || '.js', 501, 'ten' FROM {P._ROWS}")
def staged_lines(spark, d):
    return R.added_lines(_text(spark, d, "+++ b/src/m~k~.js\n@@ -~s~,2 +~s~,3 @@\n one\n+two ~k~\n-gone\n three\n@@ -400,1 +500,2 @@\n same\n+ten"))


@query(f"SELECT unnest(['A' || k, 'B' || k, 'C' || k]) AS key, unnest([s::VARCHAR, 'x ' || e, '']) AS value FROM {P._ROWS}")
def env_file(spark, d):
    return R.environment(_text(spark, d, "A~k~=~s~\n# no=1\nexport B~k~='x ~e~'\nC~k~=\nnot a line"))


_RUNS = ["~s~ passed, ~e~ failed, 1 skipped in 3s", "# pass ~s~\n# fail ~e~\n# skipped 2", "  ~s~ passing (1s)\n  ~e~ failing\n  3 pending", "test result: ok. ~s~ passed; ~e~ failed; 4 ignored", "Tests:  ~e~ failed, ~s~ passed, 5 skipped, 9 total", "ok  \ta/b\t0.1s\nFAIL\ta/c\t0.2s\nok  \ta/d\t0.1s", " ~s~ pass\n ~e~ fail\n 6 skip", "quiet ~k~"]


@query(f"SELECT k, CASE k % 8 WHEN 5 THEN 2 WHEN 7 THEN 0 ELSE s END::INT AS passed, CASE k % 8 WHEN 5 THEN 1 WHEN 7 THEN 0 ELSE e END::INT AS failed, [1, 2, 3, 4, 5, 0, 6, 0][k % 8 + 1]::INT AS skipped FROM {P._ROWS}")
def test_counts(spark, d):
    rows = P.rows(spark, d).select("k", R.test_counts(pick(_RUNS)).alias("c"))
    return rows.select("k", "c.passed", "c.failed", "c.skipped")


_HASH = "lpad(k::VARCHAR, 12, 'a')"


def _log(spark, d, body: str) -> DataFrame:
    head = F.concat(F.lpad(F.col("k").cast("string"), 12, "a"), P.fill("|Ann ~e~|2024-01-0~e~ 10:00|feat: add ~k~\n" + body))
    return lines(P.rows(spark, d).select(F.col("k").alias("doc"), head.alias("text")), "doc", "text")


@query(f"SELECT {_HASH} AS hash, 'Ann ' || e AS author, '2024-01-0' || e AS date, 'feat: add ' || k AS subject, unnest(['src/m' || k || '.js', 'src/m' || h || '.js']) AS path FROM {P._ROWS}")
def commit_files(spark, d):
    """Files of each commit of a log."""
    return R.git_log(_log(spark, d, "\nsrc/m~k~.js\nsrc/m~h~.js\n"))


@query(f"SELECT {_HASH} AS hash, 3::BIGINT AS files, (s + 5)::BIGINT AS added, e::BIGINT AS deleted FROM {P._ROWS}")
def commit_sizes(spark, d):
    """Lines that each commit added and deleted."""
    return R.numstat(_log(spark, d, "\n~s~\t~e~\tsrc/a.js\n5\t0\tsrc/b.js\n-\t-\tlogo.png"))


@query(f"SELECT k AS doc, unnest([1, 2, 3])::INT AS number, unnest([lpad(k::VARCHAR, 40, 'b'), lpad(k::VARCHAR, 40, 'c'), lpad(k::VARCHAR, 40, 'b')]) AS hash, unnest(['Ann ' || e, 'Bo', 'Ann ' || e]) AS author, unnest(['one ' || s, 'two', 'three']) AS text FROM {P._ROWS}")
def blamed_lines(spark, d):
    """Lines of a blame report with their commit and its author."""
    a, b = (F.lpad(F.col("k").cast("string"), 40, x) for x in "bc")
    text = F.concat(a, P.fill(" 1 1 1\nauthor Ann ~e~\nsummary x\n\tone ~s~\n"), b, F.lit(" 1 2 1\nauthor Bo\n\ttwo\n"), a, F.lit(" 2 3 1\n\tthree"))
    return R.porcelain(lines(P.rows(spark, d).select(F.col("k").alias("doc"), text.alias("text")), "doc", "text"))


@query(f"SELECT 'src/m' || k || '.js' AS path, s::BIGINT AS changes FROM {P._ROWS} UNION ALL SELECT 'logo' || k || '.png', NULL FROM {P._ROWS}")
def diff_sizes(spark, d):
    return R.diff_stat(_text(spark, d, " src/m~k~.js | ~s~ ++--\n logo~k~.png | Bin 0 -> 5 bytes\n 2 files changed, 3 insertions(+)"))


@query(f"SELECT {P.path_sql()} AS path, [24, 22, 20, 20, 14, 17][k % 6 + 1]::BIGINT AS changes FROM {P._ROWS}")
def untracked_files(spark, d):
    """New files with their lines."""
    return R.untracked(P.files(spark, d))


_COMMANDS = ["npm test -- ~k~", "tsc -p m~k~", "eslint src/m~k~", "./run ~k~", "./go ~k~", "ls ~k~"]
_OUTPUTS = ["", "", "", "~s~ passed\nTests: 1", "~s~ passed", "✖ 3 problems (2 errors, 1 warnings)"]


@query(f"SELECT k, ['test', 'build', 'lint', 'test', 'generic', 'lint'][k % 6 + 1] AS kind FROM {P._ROWS}")
def command_kinds(spark, d):
    return P.rows(spark, d).select("k", U.command_kind(pick(_COMMANDS), F.coalesce(pick([x or "none" for x in _OUTPUTS]))).alias("kind"))


_USED = ["npm run t~e~", "CI=1 A=b /usr/bin/node x~k~.js", "git status", "  ls -l ~e~"]


@query(f"WITH c AS (SELECT {pick_sql(_USED)} AS command, ['npm', 'node', 'git', 'ls'][k % 4 + 1] AS tool FROM {P._ROWS}) SELECT tool, count(*) AS n, list_sort(list(DISTINCT command))[1:3] AS samples FROM c GROUP BY tool ORDER BY n DESC, tool")
def tool_usage(spark, d):
    """Tools by how often they run, with up to three commands each."""
    return U.tool_usage(P.rows(spark, d).select(pick(_USED).alias("command")), "command")


@query(f"SELECT 'p' || h AS dep, list_sort(list(DISTINCT 'p' || k)) AS depended_on_by FROM {P._ROWS} WHERE h % 3 = 0 GROUP BY h")
def internal_dependencies(spark, d):
    """Packages of the workspace (every third) with those that depend on them."""
    rows = P.rows(spark, d)
    deps = rows.select(P.fill("p~k~").alias("name"), P.fill("p~h~").alias("dep")).unionByName(rows.select(P.fill("p~k~").alias("name"), F.lit("lodash").alias("dep")))
    return U.internal(deps, rows.where("k % 3 = 0").select(P.fill("p~k~").alias("name")))


_SUBJECTS = [("feat(core~e~): add ~s~", "feat", "core~e~", False), ("fix!: drop old ~k~", "fix", None, True), ("Fix crash ~s~", "fix", None, False), ("Add flags ~e~", "feat", None, False), ("refactor ~k~", "refactor", None, False), ("docs: typo ~k~", "docs", None, False), ("bump deps ~k~", "chore", None, False), ("misc ~k~", "other", None, False), ("BREAKING: remove ~k~", "breaking", None, True), ("optimise ~k~", "perf", None, False), ("test more ~k~", "test", None, False)]


def _commits(spark, d):
    subject = pick([x[0] for x in _SUBJECTS])
    rows = P.rows(spark, d).select("k", subject.alias("subject"))
    scope = F.regexp_extract("subject", C.CONVENTIONAL, 3)
    return rows.select("k", "subject", C.commit_type(F.col("subject")).alias("type"), F.when(scope != "", scope).alias("scope"), C.breaking(F.col("subject"), F.lit(None).cast("string")).alias("breaking"))


_COMMITS = f"SELECT k, {pick_sql([x[0] for x in _SUBJECTS])} AS subject, {pick_sql([x[1] for x in _SUBJECTS])} AS type, {pick_sql([x[2] for x in _SUBJECTS])} AS scope, {pick_sql([x[3] for x in _SUBJECTS])} AS breaking FROM {P._ROWS}"


@query(_COMMITS)
def commit_parse(spark, d):
    return _commits(spark, d)


@query(f"SELECT type, count(*) AS n, count(*) FILTER (breaking) AS breaking FROM ({_COMMITS}) WHERE type <> 'other' GROUP BY type")
def commits_by_type(spark, d):
    """Commits of each type but ``other``, and how many of them break something."""
    return _commits(spark, d).where("type <> 'other'").groupBy("type").agg(F.count("*").alias("n"), F.count(F.when(F.col("breaking"), 1)).alias("breaking"))


@query(f"SELECT CASE WHEN bool_or(breaking) THEN 'major' WHEN bool_or(type = 'feat') THEN 'minor' ELSE 'patch' END AS bump FROM ({_COMMITS})")
def version_bump(spark, d):
    return H.bump(_commits(spark, d))


_TAGS = ["v~e~.~s~.~d~", "~e~.~s~.~d~-rc.~k~", "~e~.~s~.~d~-beta", "latest~k~"]
_VERSIONS = f"SELECT {pick_sql(_TAGS)} AS tag, e, s, d, k % 4 = 0 AS release, CASE k % 4 WHEN 1 THEN 'rc' WHEN 2 THEN 'beta' END AS word, CASE k % 4 WHEN 1 THEN k END AS n FROM {P._ROWS} WHERE k % 4 <> 3"


@query(f"SELECT tag FROM ({_VERSIONS}) ORDER BY e DESC, s DESC, d DESC, release DESC, word DESC NULLS FIRST, n DESC NULLS LAST, tag LIMIT 40")
def semver_order(spark, d):
    """The highest versions."""
    tags = P.rows(spark, d).select(pick(_TAGS).alias("tag")).withColumn("key", C.semver(F.col("tag"))).where("key is not null")
    return tags.orderBy(F.desc("key"), "tag").limit(40).select("tag")


@query(f"SELECT max_by(tag, [e, s, d, release::INT, coalesce(ascii(word), 0), coalesce(n, 0)]) AS previous FROM ({_VERSIONS}) WHERE (e, s, d) < (3, 20, 5)")
def previous_tag(spark, d):
    """The highest tag strictly below 3.20.5-alpha, the lowest that there could be of that version."""
    key = C.semver(F.col("tag"))
    return P.rows(spark, d).select(pick(_TAGS).alias("tag")).where(key < C.semver(F.lit("3.20.5-alpha"))).agg(F.max_by("tag", key).alias("previous"))


_REQUESTS = [("review the pr ~k~", "pr-review"), ("fix the failing test ~k~", "debug"), ("close issue ~k~", "github-issue"), ("rename f~k~", "refactor"), ("understand the codebase ~e~", "onboard"), ("add a button ~k~", "feature"), ("where is f~k~", "search"), ("triage and review issues", "github-issue"), ("hello ~k~", None)]


@query(f"SELECT k, {pick_sql([r[1] for r in _REQUESTS])} AS intent FROM {P._ROWS}")
def intent_route(spark, d):
    return P.rows(spark, d).select("k", F.get(C.intents(pick([r[0] for r in _REQUESTS])), F.lit(0)).alias("intent"))


@query("SELECT DISTINCT p_type AS category, p_brand AS name FROM part WHERE NOT (p_brand = 'Brand#2' AND EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1'))")
def stack_suppression(spark, d):
    """Names of each category without those that another name absorbs."""
    rows = read(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("name")).distinct()
    return U.absorbed(rows, "category", "name", [("Brand#1", "Brand#2"), ("Brand#none", "Brand#3")])


_LINT = ["  ~s~:~e~  error  x~k~ is unused  no-unused-vars", "  4:1  warning  semi ~k~  rule-~e~", "done ~k~"]


@query(f"SELECT rule, count(*) AS n FROM (SELECT CASE k % 3 WHEN 0 THEN 'no-unused-vars' ELSE 'rule-' || e END AS rule FROM {P._ROWS} WHERE k % 3 < 2) GROUP BY rule ORDER BY n DESC, rule LIMIT 10")
def lint_violations(spark, d):
    return U.lint_rules(P.rows(spark, d).select(pick(_LINT).alias("line")))


_BUILD = [("a.ts(~s~,2): error TS2304: no name ~k~", "error"), ("main.rs: error[E0308]: types ~k~", "error"), ("x~k~.c:~s~: warning: unused", "warning"), ("ERROR in ./a~k~", None), ("error: linker failed ~k~", "error"), ("ok ~k~", None)]


@query(f"SELECT kind, count(*) AS n FROM (SELECT {pick_sql([x[1] for x in _BUILD])} AS kind FROM {P._ROWS}) WHERE kind IS NOT NULL GROUP BY kind")
def build_summary(spark, d):
    rows = P.rows(spark, d).select(U.build_line(pick([x[0] for x in _BUILD])).alias("kind"))
    return rows.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT k, {pick_sql([x[0] for x in _BUILD])} AS line FROM {P._ROWS} WHERE k % 6 IN (0, 1, 4) ORDER BY k LIMIT 15")
def build_errors(spark, d):
    """The first fifteen errors of a build."""
    return P.rows(spark, d).select("k", pick([x[0] for x in _BUILD]).alias("line")).where(U.build_line(F.col("line")) == "error").orderBy("k").limit(15)


_TITLES = [("feat: x~k~", "Features"), ("Fix y~k~", "Fixes"), ("docs: z~e~", "Docs"), ("chore ~k~", "Other")]


@query(f"SELECT section, count(*) AS n, list_position(['Features', 'Fixes', 'Docs', 'Other'], section)::INT AS place FROM (SELECT {pick_sql([x[1] for x in _TITLES])} AS section FROM {P._ROWS} WHERE s >= 10) GROUP BY section")
def release_notes(spark, d):
    """Changes since a cutoff by section, in the sections' order."""
    return U.release_sections(P.rows(spark, d).select(pick([x[0] for x in _TITLES]).alias("title"), "s"), "title", F.col("s") >= 10)


_CHANGED = [("src/m~k~.test.js", "tests", "test"), ("docs/x~k~.md", "other", "docs"), ("src/components/c~k~.js", "components", "source"), ("src/hooks/h~k~.js", "hooks", "source"), ("src/store/s~k~.js", "store", "source"), ("src/a~k~.d.ts", "types", "source"), ("data/d~k~.json", "manuscripts", "config"), ("app~k~.config.js", "config", "config"), ("logo~k~.png", "other", "assets"), ("e2e/x~k~.js", "other", "other"), ("src/a~k~.js", "other", "source")]


@query(f"SELECT k, {pick_sql([x[1] for x in _CHANGED])} AS in_diff, {pick_sql([x[2] for x in _CHANGED])} AS in_pull FROM {P._ROWS}")
def changed_paths(spark, d):
    path = pick([x[0] for x in _CHANGED])
    return P.rows(spark, d).select("k", U.diff_path(path).alias("in_diff"), U.pull_path(path).alias("in_pull"))


_NEW = "k % 3 = 0 AND k % 11 IN (2, 3, 4, 5, 7, 9, 10)"


@query(f"""WITH c AS (SELECT k, {pick_sql([x[0] for x in _CHANGED])} AS path, s * 3 AS n FROM {P._ROWS})
  SELECT path, why, priority FROM (SELECT path, n || ' lines changed' AS why, 0 AS priority FROM c WHERE n > 100 UNION ALL SELECT path, 'new file', 1 FROM c WHERE {_NEW}) ORDER BY priority, path, why LIMIT 10""")
def key_files(spark, d):
    """The changed files to read first."""
    rows = P.rows(spark, d).select(pick([x[0] for x in _CHANGED]).alias("path"), (F.col("s") * 3).alias("n"), (F.col("k") % 3 == 0).alias("added"))
    return U.key_files(rows, "path", "n", "added")


@query(f"WITH c AS (SELECT k, {pick_sql([x[0] for x in _CHANGED])} AS path FROM {P._ROWS}) SELECT path, 'new file' AS why FROM c WHERE {_NEW}")
def new_sources(spark, d):
    """New files of a known language that are no tests."""
    rows = P.rows(spark, d).select(pick([x[0] for x in _CHANGED]).alias("path"), F.lit(1).alias("n"), (F.col("k") % 3 == 0).alias("added"))
    return U.key_files(rows, "path", "n", "added", 1 << 30).select("path", "why")


_HELD = [("config/.env", True, False), ("a/Credentials~k~.txt", True, False), ("x/token.json", True, False), ("src/m~k~.js", False, False), ("node_modules/a~k~/x.js", False, True), ("src/a~k~.min.js", False, True), ("out/x.log", False, True), (".hidden~k~", False, True), ("keys/id_rsa.pub", True, False)]


@query(f"SELECT k, {pick_sql([x[1] for x in _HELD])} AS sensitive, {pick_sql([x[2] for x in _HELD])} OR k % 9 = 0 AS skipped FROM {P._ROWS}")
def held_back(spark, d):
    """Paths that must not leave, and paths that a listing passes over."""
    path = pick([x[0] for x in _HELD])
    return P.rows(spark, d).select("k", C.sensitive(path).alias("sensitive"), C.skipped_path(path).alias("skipped"))


@query(f"SELECT k AS doc, 1::BIGINT AS pos, 'export x' || k AS line FROM {P._ROWS}")
def keep_marks(spark, d):
    return U.kept_lines(_text(spark, d, "export x~k~\n// keep: used by hand\nexport y\nexport z // keep:"), "doc", "pos", "line", "keep:").select("doc", "pos", "line")


_CHANGE = ["Fix ~k~", "feature ~k~", "cleanup ~k~", "docs ~k~", "test ~k~", "chore ~k~", "x!: ~k~"]
_KINDS = ("fix", "feature", "refactor", "docs", "test", "chore", "breaking")


@query(f"SELECT s AS size, {', '.join(f'bool_or(k % 7 = {i}) AS {name}' for i, name in enumerate(_KINDS))} FROM {P._ROWS} GROUP BY s")
def change_flags(spark, d):
    rows = P.rows(spark, d).select(F.col("s").alias("size"), pick(_CHANGE).alias("title"))
    return U.change_flags(rows, "size", F.col("title"))


_ROUTED = [("src/app/s~e~/page.tsx", "/s~e~", "page"), ("app/(shop)/[id~e~]/route.ts", "/:id~e~", "api"), ("app/[...rest]/d~k~/layout.jsx", "/*/d~k~", "layout"), ("pages/api/u~k~.ts", "/api/u~k~", "api"), ("pages/[id]/index.tsx", "/:id", "page"), ("app/_lib~k~/page.tsx", None, None), ("src/x~k~.ts", None, None)]


@query(f"SELECT path, route, kind FROM (SELECT {pick_sql([x[0] for x in _ROUTED])} AS path, {pick_sql([x[1] for x in _ROUTED])} AS route, {pick_sql([x[2] for x in _ROUTED])} AS kind FROM {P._ROWS}) WHERE kind IS NOT NULL")
def framework_routes(spark, d):
    """Routes that files serve by their place."""
    return U.routes(P.rows(spark, d).select(pick([x[0] for x in _ROUTED]).alias("path")))


_SCHEMAS = ["CREATE TABLE t~k~ (id bigint PRIMARY KEY, name varchar(~s~) NOT NULL, price decimal(10, 2), PRIMARY KEY (id));\nALTER TABLE t~k~ ADD COLUMN e~e~ text;", "model M~k~ {\n  id   Int    @id\n  tags String[]\n}\n", "export const u = pgTable('t~k~', {\n  id: serial('id'),\n  n~e~: text('n')\n});", "@Entity()\nexport class E~k~ {\n  @PrimaryColumn() id: number;\n  @Column({ nullable: true }) n~e~?: string;\n}", "const S~k~ = new mongoose.Schema({\n  a: String,\n  n~e~: { type: Number, required: true },\n});"]
_FIELDS = {0: ("sql", "t~k~", [("id", "bigint"), ("name", "varchar(~s~)"), ("price", "decimal(10,2)"), ("e~e~", "text")]), 1: ("prisma", "M~k~", [("id", "Int"), ("tags", "String[]")]), 2: ("drizzle", "t~k~", [("id", "serial"), ("n~e~", "text")]), 3: ("typeorm", "E~k~", [("id", "number"), ("n~e~", "string")]), 4: ("mongoose", "S~k~", [("a", "String"), ("n~e~", "Number")])}


@query(" UNION ALL ".join(f"SELECT '{form}' AS format, {P.fill_sql(name)} AS \"table\", {P.fill_sql(f)} AS field, {P.fill_sql(t)} AS type FROM {P._ROWS} WHERE k % 5 = {i}" for i, (form, name, fields) in _FIELDS.items() for f, t in fields))
def schema_fields(spark, d):
    """Fields of the tables that schema files of five kinds define."""
    files = P.rows(spark, d).select(P.fill("schema~k~").alias("path"), F.lit("").alias("lang"), pick(_SCHEMAS).alias("content"))
    return K.scan(files, "schema").drop("path", "lang")


_MANIFESTS = [("package.json", '{"name":"p~k~","dependencies":{"a~e~":"^~s~.0"},"devDependencies":{"b":"1"}}', [("dependencies", "a~e~", "^~s~.0"), ("devDependencies", "b", "1")]), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b~e~ v1.~s~.0\n)\n", [("require", "github.com/a/b~e~", "v1.~s~.0")]), ("requirements.txt", "# c\nFlask~e~==~s~.1\nrequests\n", [("requirements", "flask~e~", "==~s~.1"), ("requirements", "requests", "")]), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "~s~"\ntokio~e~ = { features = [], version = "1" }\n', [("dependencies", "serde", "~s~"), ("dependencies", "tokio~e~", "1")]), ("docker-compose.yml", "services:\n  db:\n    image: postgres:~s~\n", [("image", "postgres", "~s~")])]


@query(" UNION ALL ".join(f"SELECT k, '{section}' AS section, {P.fill_sql(name)} AS name, {P.fill_sql(version)} AS version FROM {P._ROWS} WHERE k % 5 = {i}" for i, (_, _, found) in enumerate(_MANIFESTS) for section, name, version in found))
def manifest_dependencies(spark, d):
    """What manifests of five kinds depend on."""
    files = P.rows(spark, d).select(F.col("k").alias("path"), pick([m[0] for m in _MANIFESTS]).alias("lang"), pick([m[1] for m in _MANIFESTS]).alias("content"))
    return K.scan(files, "manifest").select(F.col("path").cast("bigint").alias("k"), "section", "name", "version")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 3")
def newest_sessions(spark, d):
    """The three newest of each kind."""
    return R.newest(read(spark, d, "events"), "event_type", "ts", "event_id", 3).select("event_type", "event_id")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> '') AS event_type, arg_max(CASE WHEN event_type = 'click' THEN 'c' || event_id END, event_id) FILTER (event_type = 'click') AS slug FROM events GROUP BY user_id""")
def merged_sessions(spark, d):
    """What is known of each user: each field's last value that isn't empty."""
    rows = read(spark, d, "events").withColumn("slug", F.when(F.col("event_type") == "click", F.concat(F.lit("c"), F.col("event_id").cast("string"))).when(F.col("event_type") == "view", ""))
    return R.merged(rows, "user_id", "event_id", ["event_type", "slug"])


@query(f"SELECT path, pos FROM (SELECT path, line::BIGINT AS pos FROM ({P.expected('type, message, author, line', P.TODOS)}))")
def named_search(spark, d):
    """Lines that a named pattern finds."""
    return R.named_search(lines(P.files(spark, d), "path", "content"), "todos").select("path", "pos")


@query("SELECT json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey)::VARCHAR AS json FROM nation")
def json_rows(spark, d):
    return U.rendered(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""WITH r AS (SELECT substr(md5('/' || user_id || ':test'), 1, 12) AS key, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 1)) AS now, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 0)) AS was FROM events GROUP BY user_id)
  SELECT key, list_sort(list_filter(now, lambda x: NOT list_contains(coalesce(was, []), x))) AS fresh, list_sort(list_filter(coalesce(was, []), lambda x: NOT list_contains(now, x))) AS gone FROM r WHERE now IS NOT NULL""")
def previous_runs(spark, d):
    """What each run (odd events) says that the kept one before it (even events) doesn't, and the reverse."""
    rows = read(spark, d, "events").withColumn("key", R.snapshot_key(F.concat(F.lit("/"), F.col("user_id").cast("string")), F.lit("test")))
    run, kept = (rows.where(F.col("event_id") % 2 == k).groupBy("key").agg(F.collect_set("event_type").alias("lines")) for k in (1, 0))
    return R.against_previous(run, kept, "key", "lines")


_DIVERSE = """m AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'usage' WHEN 'A' THEN 'definition' ELSE 'test' END AS kind, l_suppkey % 3 AS folder, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
  a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY list_position(['usage', 'definition', 'test'], kind), pos) AS nr FROM m),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, folder ORDER BY nr) = 1 AS one FROM a),
  c AS (SELECT *, NOT bool_or(one) OVER (PARTITION BY l_orderkey, l_suppkey) AND row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY nr) = 1 AS two FROM b),
  e AS (SELECT *, NOT bool_or(one OR two) OVER (PARTITION BY l_orderkey, kind) AND row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY nr) = 1 AS three FROM c)"""


@query(f"WITH {_DIVERSE} SELECT l_orderkey, pos, nth FROM (SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN one THEN 1 WHEN two THEN 2 WHEN three THEN 3 ELSE 4 END, nr)::INT AS nth FROM e) WHERE nth <= 4")
def diverse_matches(spark, d):
    """Four examples of each order, as different as can be."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "R", "usage").when(F.col("l_returnflag") == "A", "definition").otherwise("test")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_suppkey") % 3).alias("folder"), kind.alias("kind"), F.row_number().over(order).cast("bigint").alias("pos"))
    return U.diverse(rows, "l_orderkey", "folder", "l_suppkey", "kind", "pos", 4).select("l_orderkey", "pos", "nth")


@query(f"SELECT path, line, arg_min(what, nr) AS what FROM (SELECT path, line, method AS what, 0 AS nr FROM ({P.expected('method, route, line, handler, framework', P.ENDPOINTS)}) UNION ALL SELECT path, line, name, 1 FROM ({P.expected('name, line, kind', P.EXPORTS)})) GROUP BY path, line")
def united_finds(spark, d):
    """Endpoints and exports, a line once."""
    files = P.files(spark, d)
    a = K.scan(files, "endpoints").select("path", "line", F.col("method").alias("what"), F.lit(0).alias("nr"))
    b = K.scan(files, "exports").select("path", "line", F.col("name").alias("what"), F.lit(1).alias("nr"))
    return U.united(a, b, key=["path", "line"], order="nr").select("path", "line", "what")


_NAMES = [("getItem~k~", "camel"), ("Item~k~", "pascal"), ("get_item~k~", "snake"), ("get-item~k~", "kebab"), ("X", None)]


@query(f"SELECT e, count(*) FILTER (k % 5 = 0) AS camel, count(*) FILTER (k % 5 = 1) AS pascal, count(*) FILTER (k % 5 = 2) AS snake, count(*) FILTER (k % 5 = 3) AS kebab FROM (SELECT s % 7 AS e, k FROM {P._ROWS}) GROUP BY e")
def naming_counts(spark, d):
    """Naming conventions by group."""
    rows = P.rows(spark, d).select((F.col("s") % 7).alias("e"), X.naming(pick([x[0] for x in _NAMES])).alias("c"))
    return rows.groupBy("e").agg(*(F.count(F.when(F.col("c") == c, 1)).alias(c) for c in ("camel", "pascal", "snake", "kebab")))


@query(f"SELECT 'V' || e AS name, list_sort(list(DISTINCT {P.path_sql()})) AS files FROM {P._ROWS} WHERE k % 6 = 2 GROUP BY e")
def env_usage(spark, d):
    """Environment variables and the files that read them."""
    pattern = F.lit("(?:process[.]env[.]|getenv\\([\"']|environ\\[[\"'])([A-Za-z_][A-Za-z0-9_]*)")
    found = P.files(spark, d).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", pattern, F.lit(1)))).alias("name"))
    return found.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("files"))
