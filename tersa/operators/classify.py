"""Ordered rules over paths, intents, URLs, tags, commits, markers and risks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions import text as X


def first_match(rules, otherwise: Column | str | None = None) -> Column:
    """The value of the first rule (condition, value) that holds."""
    chain = reduce(lambda c, r: F.when(r[0], r[1]) if c is None else c.when(r[0], r[1]), rules, None)
    return chain.otherwise(otherwise)


def file_category(path: Column) -> Column:
    lower = F.lower(path)
    return first_match([(lower.rlike("e2e|cypress|playwright"), "e2e"), (lower.rlike("mock|fixture"), "mock"), (lower.rlike("stories|storybook"), "story"), (lower.rlike("test|spec"), "test")], "source")


#: Languages by extension.
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "rb": "ruby", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "php": "php", "swift": "swift", "kt": "kotlin", "sql": "sql", "sh": "shell"}


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), X.extension(path))


#: What a listing passes over, and what it shows first.
SKIPPED_FOLDERS = "node_modules .git android ios dist build .expo .next coverage __pycache__ .cache .turbo .venv venv env .tox .mypy_cache .pytest_cache vendor target out .gradle .idea .vscode".split()
SKIPPED_EXTENSIONS = "jpg jpeg png gif ico svg webp mp3 mp4 wav webm ogg woff woff2 ttf eot zip tar gz rar pdf doc docx lock log map".split()
IMPORTANT = "package.json tsconfig.json README.md app.json .env.example index.ts index.tsx index.js Cargo.toml go.mod pyproject.toml requirements.txt Makefile Dockerfile docker-compose.yml".split()
IMPORTANT_FOLDERS = "src app components lib utils hooks store api services types scripts tests test __tests__ spec cmd pkg internal".split()


def skipped(name: Column, is_folder: bool = False) -> Column:
    """Whether a listing passes over a name: hidden, a folder of the list, an ending of the list, or minified."""
    hidden = name.startswith(".") & ~name.isin(IMPORTANT_FOLDERS)
    return hidden | (name.isin(SKIPPED_FOLDERS) if is_folder else X.extension(name).isin(SKIPPED_EXTENSIONS) | name.rlike("[.]min[.](js|css)$"))


def skipped_path(path: Column) -> Column:
    """Whether any folder of a path or its name is passed over."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda x: skipped(x, True)) | skipped(F.element_at(parts, -1))


#: Endings of files that hold no text.
BINARY_EXTENSIONS = "png jpg jpeg gif bmp ico webp mp3 wav mp4 mov zip gz tgz bz2 xz 7z tar woff woff2 ttf otf eot pdf wasm exe dll so bin dat db sqlite class o a pyc".split()
#: Control characters are binary from this many and this share of a text; larger files are passed over.
CONTROL_LEAST, CONTROL_SHARE, CONTROL_BYTES = 5, 0.02, 5 << 20
CONTROL_CLASS = "[\\x00-\\x08\\x0e-\\x1f]"


def important(name: Column, is_folder: bool = False) -> Column:
    return name.isin(IMPORTANT_FOLDERS if is_folder else IMPORTANT)


def binary(path: Column) -> Column:
    return X.extension(path).isin(BINARY_EXTENSIONS)


def control_mark(path: Column, content: Column) -> Column:
    """offset and name of the first control character of a text that is none of a binary; null without one."""
    n = F.regexp_count(content, F.lit(CONTROL_CLASS))
    size = F.octet_length(content)
    offset = F.octet_length(F.regexp_extract(content, f"(?s)^(.*?){CONTROL_CLASS}", 1))
    code = F.ascii(F.regexp_extract(content, f"({CONTROL_CLASS})", 1))
    name = F.when(code == 0, "NUL").when(code == 27, "ESC").otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(code.cast("bigint"))), 2, "0")))
    told = (n > 0) & ~((n >= CONTROL_LEAST) & (n / size > CONTROL_SHARE)) & (size <= CONTROL_BYTES) & ~binary(path)
    return F.when(told, F.struct(offset.alias("offset"), name.alias("name")))


#: Paths that must not leave.
SENSITIVE = ("\\.env$", "(?i)credentials", "(?i)secret", "\\.pem$", "\\.key$", "id_rsa", "id_ed25519", "token\\.json$", "\\.npmrc$")


def sensitive(path: Column) -> Column:
    return path.rlike("|".join(f"({p})" for p in SENSITIVE))


def contains_path(parent: Column, child: Column) -> Column:
    return (child == parent) | child.startswith(F.concat(F.regexp_replace(parent, "/+$", ""), F.lit("/")))


#: Intents in their order, with the words that mean them.
INTENTS = (
    ("pr-review", "pr|pull request|review"),
    ("debug", "debug|bug|failing|failure|fix test|test fail|repro"),
    ("github-issue", "issues?|sub-issues?|github issue|close issue|label issue|triage"),
    ("refactor", "refactor|rename|move|extract|cleanup|clean up"),
    ("onboard", "understand|onboard|explore|map|overview|architecture|codebase|repo"),
    ("test", "tests?|coverage|specs?|assertions?"),
    ("validate", "typecheck|type check|build|lint|check|ci|verify|validate"),
    ("maintenance", "unused|dead code|dead exports|orphan|circular|cycles?|secrets?|todo|todos"),
    ("search", "search|find|locate|grep|rg|usages?|references?|where is"),
    ("deps", "upgrade|update|bump|migrate|dependency|dependencies|package"),
    ("feature", "add|implement|feature|support"),
    ("docs", "docs|documentation|api docs|lookup|look up|context7|library"),
    ("commit", "commit|push|ship|land|pre-commit"),
)


def intents(text: Column) -> Column:
    """All intents of a request, in order; the first is the primary one."""
    return F.array_compact(F.array(*(F.when(X.has_word(text, words) & (~text.rlike("(?i)(^|[^a-z])issues?($|[^a-z])") | X.has_word(text, "pr|pull request") if name == "pr-review" else F.lit(True)), F.lit(name)) for name, words in INTENTS)))


def semver(tag: Column) -> Column:
    """A key that sorts tags by precedence; null for what is no version."""
    pattern = "^[vV]?([0-9]+)[.]([0-9]+)[.]([0-9]+)(-([0-9A-Za-z.-]+))?([+][0-9A-Za-z.-]+)?$"
    number = [F.regexp_extract(tag, pattern, k).cast("bigint") for k in (1, 2, 3)]
    pre = F.regexp_extract(tag, pattern, 5)
    fields = F.transform(F.split(pre, "[.]"), lambda x: F.struct((~x.rlike("^[0-9]+$")).alias("alpha"), F.when(x.rlike("^[0-9]+$"), x.cast("bigint")).otherwise(0).alias("n"), F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("s")))
    return F.when(tag.rlike(pattern), F.struct(number[0].alias("major"), number[1].alias("minor"), number[2].alias("patch"), (pre == "").alias("release"), fields.alias("pre")))


CONVENTIONAL = "^([A-Za-z0-9_]+)(\\(([^)]+)\\))?(!)?:[ \\t]*(.+)$"
#: Types of subjects that follow no convention, by the first pattern that hits.
COMMIT_TYPES = (
    ("fix", "^fix|bug"),
    ("feat", "^(add|update|improve)|feature|implement"),
    ("refactor", "^refactor|cleanup"),
    ("docs", "^doc|readme"),
    ("test", "^test"),
    ("perf", "perf|optim"),
    ("chore", "^chore|deps|bump"),
)


def by_pattern(text: Column, table, otherwise: str | None = None) -> Column:
    """The name of the first (name, pattern) whose pattern hits."""
    return first_match([(text.rlike(pattern), name) for name, pattern in table], otherwise)


def commit_type(subject: Column) -> Column:
    stated = F.nullif(F.lower(F.regexp_extract(subject, CONVENTIONAL, 1)), F.lit(""))
    return F.coalesce(stated, by_pattern(F.lower(subject), COMMIT_TYPES, "other"))


def breaking(subject: Column, body: Column) -> Column:
    return subject.contains("!:") | F.upper(subject).contains("BREAKING") | F.coalesce(F.upper(body).contains("BREAKING CHANGE"), F.lit(False))


#: Markers and their priorities.
MARKERS = {"FIXME": 1, "FIX": 1, "BUG": 1, "TODO": 2, "HACK": 3, "WORKAROUND": 3, "XXX": 4, "WARN": 4, "NOTE": 5, "INFO": 5}
_MARK = "|".join(MARKERS)


def marker_line(line: Column) -> Column:
    return line.rlike(f"(?i)(//|#|--|\\*|<!--|\\{{#)[ \\t]*({_MARK})[:(]")


def marker(line: Column) -> Column:
    """type, message, author and priority of a marker line; null if its message is no message."""
    kind = F.upper(F.regexp_extract(line, f"(?i)({_MARK})[: \\t(]+(.*)", 1))
    rest = F.trim(F.regexp_extract(line, f"(?i)({_MARK})[: \\t(]+(.*)", 2))
    for end in ("\\*/[ \\t]*$", "-->[ \\t]*$", "\\)[ \\t]*$"):
        rest = F.regexp_replace(rest, end, "")
    rest = F.trim(rest)
    author, said = F.regexp_extract(rest, "^[@(]([A-Za-z0-9_]+)\\)?[: \\t]+(.+)$", 1), F.regexp_extract(rest, "^[@(]([A-Za-z0-9_]+)\\)?[: \\t]+(.+)$", 2)
    named = (author != "") & (F.length(author) < 15) & (F.length(said) > 5)
    priority = F.element_at(F.create_map(*(F.lit(x) for kv in MARKERS.items() for x in kv)), kind)
    fine = (F.length(rest) >= 3) & ~rest.rlike("^[{(\\[;,=]") & ~rest.rlike("^─+$")
    return F.when(fine, F.struct(kind.alias("type"), F.substring(F.when(named, said).otherwise(rest), 1, 200).alias("message"), F.when(named, author).alias("author"), F.coalesce(priority, F.lit(2)).alias("priority")))


def buckets(value: Column, limits, beyond) -> Column:
    """The value of the first (limit, value) that ``value`` doesn't exceed."""
    return first_match([(value <= limit, F.lit(v)) for limit, v in limits], F.lit(beyond))


#: Parts of a risk, each with its weight, the points up to each limit, and those beyond.
RISK_PARTS = {
    "importers": (0.4, ((0, 1), (2, 2), (5, 4), (15, 7)), 9),
    "complexity": (0.3, ((5, 1), (10, 3), (20, 5), (40, 7)), 9),
    "uncovered": (0.3, ((1, 1), (2, 3), (3, 5)), 8),
}
#: What to do first, by the first condition that holds.
ADVICE = (
    ("tests = 0", "cover it with tests first"),
    ("cases < 3", "add test cases"),
    ("complexity > 20", "split its complex functions"),
    ("importers > 15", "look at everything that imports it"),
)


def risk(importers: Column, complexity: Column, tests: Column, cases: Column) -> Column:
    """1 to 10, from the points of RISK_PARTS; how little is tested is ranked 1 (ten cases or more) to 4 (no tests)."""
    values = {"importers": importers, "complexity": complexity, "uncovered": 4 - (tests > 0).cast("int") - (cases >= 3).cast("int") - (cases >= 10).cast("int")}
    values["uncovered"] = F.when(tests == 0, 4).otherwise(values["uncovered"])
    points = reduce(lambda total, part: total + buckets(values[part[0]], *part[1][1:]) * part[1][0], RISK_PARTS.items(), F.lit(0.0))
    return F.least(F.greatest(F.floor(points + 0.5), F.lit(1)), F.lit(10)).cast("int")


def risk_advice(importers: Column, complexity: Column, tests: Column, cases: Column) -> Column:
    """The first advice whose condition, over these four by their names, holds."""
    named = F.struct(importers.alias("importers"), complexity.alias("complexity"), tests.alias("tests"), cases.alias("cases"))

    def holds(condition: str) -> Column:
        name, sign, limit = condition.split()
        return {"=": named[name] == int(limit), "<": named[name] < int(limit), ">": named[name] > int(limit)}[sign]

    return first_match([(holds(condition), said) for condition, said in ADVICE], "nothing stands out")


def without_strings(code: Column) -> Column:
    for pattern, plain in (("(?m)//.*$", ""), ("(?s)/\\*.*?\\*/", ""), ("`[^`]*`", '""'), ('"(?:[^"\\\\\\n]|\\\\.)*"', '""'), ("'(?:[^'\\\\\\n]|\\\\.)*'", "''")):
        code = F.regexp_replace(code, pattern, plain)
    return code


#: What adds a path through code.
DECISIONS = ("\\bif\\s*\\(", "\\belse\\s+if\\s*\\(", "\\bfor\\s*\\(", "\\bwhile\\s*\\(", "\\bdo\\s*\\{", "\\bcase\\s+[^:]+:", "\\bcatch\\s*\\(", "\\?\\s*[^:]", "&&", "\\|\\|", "\\?\\?")


def cyclomatic(code: Column) -> Column:
    clean = without_strings(code)
    return reduce(lambda total, p: total + F.regexp_count(clean, F.lit(p)), DECISIONS, F.lit(1))


#: What weighs by its depth, once a line; what counts one, once a line; what counts one each time.
DEEP = ("\\bfor\\s*\\(", "\\bwhile\\s*\\(", "\\bdo\\s*\\{", "\\bswitch\\s*\\(", "\\bcatch\\s*\\(", "^(?!.*\\belse\\s+if).*\\bif\\s*\\(")
SHALLOW = ("\\belse\\s+if\\s*\\(", "\\belse\\s*\\{")
EACH = ("&&", "\\|\\|", "\\?\\?", "\\?[^:?]")


def cognitive(code: Column) -> Column:
    """Control flow weighted by its depth in braces, which never falls below zero. Blank lines and comments are passed over."""

    def facts(line: Column) -> Column:
        once = lambda table: reduce(lambda n, p: n + line.rlike(p).cast("int"), table, F.lit(0))
        each = reduce(lambda n, p: n + F.regexp_count(line, F.lit(p)), EACH, once(SHALLOW))
        return F.struct(once(DEEP).alias("deep"), each.alias("flat"), (F.regexp_count(line, F.lit("\\{")) - F.regexp_count(line, F.lit("\\}"))).alias("step"))

    told = F.filter(F.transform(F.split(code, "\n"), lambda line: F.trim(line)), lambda line: ~line.rlike("^($|//|\\*)"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("depth"))

    def step(at: Column, line: Column) -> Column:
        return F.struct((at["sum"] + line["flat"] + line["deep"] * (at["depth"] + 1)).alias("sum"), F.greatest(at["depth"] + line["step"], F.lit(0)).alias("depth"))

    return F.aggregate(F.transform(told, facts), start, step, lambda at: at["sum"])


def rating(n: Column) -> Column:
    return buckets(n, [(10, "simple"), (20, "moderate"), (50, "complex")], "very complex")
