"""Column functions over text, all built-in expressions. Classes are ASCII and spelled out, so that other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = "[ \\t\\n\\r\\f]"
IDENTIFIER = "[A-Za-z_$][A-Za-z0-9_$]*"
#: Words that stay in a structural body.
KEYWORDS = (
    "if else for while switch case return break continue function const let var new class import export from default "
    "try catch finally throw async await yield typeof instanceof in of do void this super extends implements "
    "delete null true false undefined func fn fun def pub use mod struct impl trait enum match where as move ref "
    "static public private protected final override abstract interface package namespace using val when is mut self "
    "crate dyn unsafe go defer chan select type"
).split()


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def body_tokens(text: Column) -> Column:
    """Tokens of a body with collapsed white space, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), token_estimate(collapse(F.coalesce(text, F.lit("")))))


def format_tokens(n: Column) -> Column:
    """One decimal, half up, with k or M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", F.floor((n + 50_000) / 100_000) / 10.0)).when(n >= 1000, F.format_string("%.1fk", F.floor((n + 50) / 100) / 10.0)).otherwise(n.cast("string"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_comments(text: Column, python: bool = False) -> Column:
    if python:
        return F.regexp_replace(text, "#[^\\n]*", " ")
    return F.regexp_replace(F.regexp_replace(text, "(?s)/\\*.*?\\*/", " "), "//[^\\n]*", " ")


def normal_body(text: Column, python: bool = False) -> Column:
    return collapse(strip_comments(text, python))


def structural_body(text: Column, python: bool = False) -> Column:
    """The normal body with every identifier but keywords as one underscore."""
    kept = "|".join(KEYWORDS)
    marked = F.regexp_replace(normal_body(text, python), f"(?<![A-Za-z0-9_$])(?!(?:{kept})(?![A-Za-z0-9_$])){IDENTIFIER}", "_")
    return F.regexp_replace(marked, f"{SPACE}+", " ")


def code_tokens(text: Column) -> Column:
    """Identifiers and single other characters."""
    return F.size(F.regexp_extract_all(text, F.lit(f"{IDENTIFIER}|[^ \\t\\n\\r\\fA-Za-z_$]"), F.lit(0))).cast("bigint")


def digest(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def identifier_words(text: Column) -> Column:
    """Lower-case words of an identifier or phrase: camelCase, snake_case, kebab, dots and paths break apart."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens; all of them, if fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.array_distinct(runs)


EDGE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def log_template(line: Column) -> Column:
    """A log line with time stamps, ids and numbers as placeholders."""
    rules = (
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]+)?Z", "<ts>"),
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"),
        ("[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]+)?", "<time>"),
        ("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", "<uuid>"),
        ("(?i)0x[0-9a-f]+", "<hex>"),
        ("(?i)[0-9a-f]{10,}", "<hex>"),
        ("[0-9]+", "<n>"),
    )
    for pattern, mark in rules:
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        line = F.regexp_replace(line, f"{flag}{EDGE[0]}(?:{pattern.removeprefix('(?i)')}){EDGE[1]}", mark)
    return line


#: Words that make a line an error or a warning.
ERROR_WORDS = "error|err|fatal|panic|exception|traceback|uncaught|failed|failure|critical|segfault"
WARN_WORDS = "warn|warning|deprecated|retry|slow"


def has_word(text: Column, words: str, ignore_case: bool = True) -> Column:
    return text.rlike(f"{'(?i)' if ignore_case else ''}(^|[^A-Za-z0-9_])({words})($|[^A-Za-z0-9_])")


def severity(line: Column) -> Column:
    return F.when(has_word(line, ERROR_WORDS), "error").when(has_word(line, WARN_WORDS), "warn").otherwise("info")


def severity_rank(name: Column) -> Column:
    return F.when(name == "error", 2).when(name == "warn", 1).otherwise(0)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;?]*[A-Za-z]|\\x1b\\][^\\x07]*\\x07", "")


def shorten(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def extension(path: Column) -> Column:
    return F.when(path.contains("."), F.lower(F.element_at(F.split(path, "\\."), -1))).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decode_entities(text: Column) -> Column:
    for entity, plain in (("&#32;", " "), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


#: What a tag becomes: block tags leave line breaks, code tags their marks.
TAG_RULES = (
    ("(?i)<br[ \\t\\n\\r\\f]*/?>", "\n"),
    ("(?i)</p>", "\n\n"),
    ("(?i)</li>", "\n"),
    ("(?i)<li>", "- "),
    ("(?i)</?code>", "`"),
    ("(?i)</?pre>", "\n```\n"),
    ("<[^>]+>", ""),
    ("\n{3,}", "\n\n"),
)


def strip_tags(html: Column) -> Column:
    for pattern, plain in TAG_RULES:
        html = F.regexp_replace(html, pattern, plain)
    return F.regexp_replace(html, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")


def main_content(html: Column) -> Column:
    """Inside of <main>, else of <article>, else everything."""
    def inside(tag: str) -> Column:
        return F.nullif(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*)</{tag}>", 1), F.lit(""))

    return F.coalesce(inside("main"), inside("article"), html)


DROPPED = ("nav", "footer", "header", "aside", "script", "style", "svg", "noscript", "form")


def markdown(html: Column) -> Column:
    """Main content as Markdown: boilerplate elements dropped, headings, links, lists and emphasis kept."""
    out = main_content(html)
    for tag in DROPPED:
        out = F.regexp_replace(out, f"(?is)<{tag}(?: [^>]*)?>.*?</{tag}>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, f"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    out = F.regexp_replace(out, "(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**")
    return decode_entities(strip_tags(out))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in ".+^${}()|[]\\" else "") + glob[i], i + 1
    return f"^{out}$"


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def shell_quote(text: Column) -> Column:
    """In single quotes; a single quote inside ends them, stands escaped, and opens them again."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def count_braces(line: Column) -> Column:
    """Opening less closing braces outside of strings and line comments."""
    bare = line
    for pattern in ('"(?:[^"\\\\]|\\\\.)*"', "'(?:[^'\\\\]|\\\\.)*'", "`(?:[^`\\\\]|\\\\.)*`", "//.*$"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.regexp_count(bare, F.lit("\\{")) - F.regexp_count(bare, F.lit("\\}"))


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO time stamp (UTC without a zone); null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def elapsed(ms: Column) -> Column:
    """850ms, 12.3s or 2m 5s."""
    seconds = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", F.floor(ms / 100) / 10.0)).otherwise(F.format_string("%dm %ds", F.floor(seconds / 60).cast("bigint"), (seconds % 60).cast("bigint")))


def time_until(at: Column, now: Column) -> Column:
    """now, 45m, 3h 20m or 2d 4h from one time stamp to a later one."""
    minutes = F.floor((F.unix_seconds(at) - F.unix_seconds(now)) / 60).cast("bigint")
    hours, days = F.floor(minutes / 60).cast("bigint"), F.floor(minutes / 1440).cast("bigint")
    return F.when(minutes <= 0, "now").when(minutes < 60, F.format_string("%dm", minutes)).when(hours < 24, F.format_string("%dh %dm", hours, minutes % 60)).otherwise(F.format_string("%dd %dh", days, hours % 24))


def size_bytes(text: Column) -> Column:
    """Bytes of 12, 12KB, 1.5 MB, 2GB; null if it is no size."""
    pattern = "(?i)^ *([0-9]+(?:[.][0-9]+)?) *(b|kb|mb|gb)? *$"
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1)
    return F.when(text.rlike(pattern), F.floor(F.regexp_extract(text, pattern, 1).cast("double") * factor).cast("bigint"))


def indent_size(text: Column) -> Column:
    """The most frequent step of indentation among 2, 4 and 8 (the smaller of equals), ``tab``, or null without any."""
    lead = F.regexp_extract_all(text, F.lit("(?m)^([ \\t]+)[^ \\t\\n]"), F.lit(1))
    count = lambda test: F.size(F.filter(lead, test))
    tabs, two, four, eight = count(lambda x: x.startswith("\t")), count(lambda x: F.length(x) == 2), count(lambda x: F.length(x) == 4), count(lambda x: F.length(x) == 8)
    most = F.greatest(tabs, two, four, eight)
    return F.when(most == 0, F.lit(None)).when(tabs == most, "tab").when(two == most, "2").when(four == most, "4").otherwise("8")


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def tool_arguments(arguments: Column, name: str) -> Column:
    """An argument of a call whose arguments are a JSON object or a JSON string that holds one."""
    return F.coalesce(F.get_json_object(arguments, f"$.{name}"), F.get_json_object(F.get_json_object(F.concat(F.lit('{"x":'), arguments, F.lit("}")), "$.x"), f"$.{name}"))


def content_text(content: Column) -> Column:
    """Text of a JSON content that is a string or an array of parts with text, one part a line."""
    wrapped = F.concat(F.lit('{"x":'), content, F.lit("}"))
    parts = F.from_json(wrapped, "x array<struct<text: string>>")["x"]
    return F.when(F.trim(content).startswith("["), F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")).otherwise(F.from_json(wrapped, "x string")["x"])


def short_hash(text: Column, kind: str = "sha1") -> Column:
    """The first hex digits that name a text: 12 of SHA-1 or MD5, 16 of SHA-256."""
    return {"sha1": F.substring(F.sha1(text), 1, 12), "md5": F.substring(F.md5(text), 1, 12), "sha256": F.substring(F.sha2(text, 256), 1, 16)}[kind]


def naming(name: Column) -> Column:
    """camel, pascal, snake or kebab; null for anything else."""
    return F.when(name.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel").when(name.rlike("^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)*$"), "pascal").when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake").when(name.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), "kebab")


def deep_merge(base: dict, over: dict) -> dict:
    """Settings over settings: objects are merged, anything else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
