"""Scanners over source text in Arrow batches: definitions, imports, exports, calls, types, docs, endpoints, components, errors.

Every file is read once: strings and comments are blanked, lines and block ends are indexed in one
pass, and all scanners ask that index. A language is a family (braces, indentation, ``end`` keywords)
and a table of what opens a definition; unknown languages use the generic table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

NAME = r"[A-Za-z_$][\w$]*"
#: Control words that look like calls or methods.
CONTROL = set("if for while switch catch do else return function with await super typeof case".split())
INDENTED, ENDED = {"python"}, {"ruby", "elixir", "lua"}
SCRIPT = {"javascript", "typescript"}
#: What opens a definition, by language: (kind, pattern over blanked text); the name is group ``n``.
_JS = (
    ("function", rf"\bfunction\s*\*?\s*(?P<n>{NAME})\s*(?=[(<])"),
    ("class", rf"\bclass\s+(?P<n>{NAME})"),
    ("function", rf"\b(?:const|let|var)\s+(?P<n>{NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{NAME})\s*(?::[^={{;]+)?=>"),
    ("method", rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|override)\s+)*(?P<n>#?{NAME})\s*\([^;{{}}]*\)\s*(?::[^{{;=]+)?(?=\{{)"),
)
_TS = (("interface", rf"\binterface\s+(?P<n>{NAME})"), ("type", rf"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>{NAME})\s*(?:<[^=]*>)?\s*="), ("enum", rf"\benum\s+(?P<n>{NAME})"))
DEFINES = {
    "javascript": _JS,
    "typescript": _JS + _TS,
    "python": (("class", r"(?m)^[ \t]*class\s+(?P<n>\w+)"), ("function", r"(?m)^[ \t]*(?:async\s+)?def\s+(?P<n>\w+)")),
    "go": (
        ("method", r"(?m)^func\s*\([^)]*\)\s*(?P<n>\w+)\s*(?=[(\[])"),
        ("function", r"(?m)^func\s+(?P<n>\w+)\s*(?=[(\[])"),
        ("struct", r"(?m)^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"(?m)^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type", r"(?m)^type\s+(?P<n>\w+)\s+(?!struct\b|interface\b)"),
        ("const", r"(?m)^const\s+(?P<n>\w+)"),
        ("var", r"(?m)^var\s+(?P<n>\w+)"),
    ),
    "rust": tuple(
        (kind, rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?{words}\s+(?P<n>\w+)")
        for kind, words in (("function", r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn"), ("struct", "struct"), ("enum", "enum"), ("trait", r"(?:unsafe\s+)?trait"), ("module", "mod"), ("type", "type"), ("const", "const"), ("static", r"static(?:\s+mut)?"))
    )
    + (("impl", r"(?m)^[ \t]*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)"),),
    "ruby": (("class", r"(?m)^[ \t]*class\s+(?P<n>[A-Z]\w*(?:::\w+)*)"), ("module", r"(?m)^[ \t]*module\s+(?P<n>[A-Z]\w*(?:::\w+)*)"), ("function", r"(?m)^[ \t]*def\s+(?:self\.)?(?P<n>\w+[?!=]?)")),
}
GENERIC = tuple((kind, rf"(?m)^[ \t]*(?:[\w]+\s+)*?{word}\s+(?P<n>{NAME})") for word, kind in (("class", "class"), ("struct", "struct"), ("interface", "interface"), ("trait", "trait"), ("enum", "enum"), ("module", "module"), ("(?:function|func|fun|fn|def|sub|proc)", "function"))) + (
    ("function", rf"(?m)^[ \t]*(?:[\w<>\[\],*&:]+[ \t]+)+(?P<n>{NAME})\s*\([^;{{}}]*\)\s*(?=\{{)"),
)
FUNCTIONS = {"function", "method"}
#: Strings and comments, by family.
_HIDDEN = {
    "slash": re.compile(r"""//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\.)'""", re.S),
    "python": re.compile(r"""#[^\n]*|(?:\"{3}.*?\"{3}|'{3}.*?'{3})|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S),
    "hash": re.compile(r"""#(?!\{)[^\n]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", re.S),
    "lua": re.compile(r"""--\[\[.*?\]\]|--[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S),
}


@dataclass(frozen=True)
class Definition:
    kind: str
    name: str
    #: Offsets of the definition and of its block (after the brace), which is empty without one.
    start: int
    opened: int
    end: int
    line: int
    end_line: int


class Source:
    """A file's text, its text without strings and comments, its lines and its definitions."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        family = "python" if lang == "python" else "rust" if lang == "rust" else "lua" if lang == "lua" else "hash" if lang in ("ruby", "elixir", "shell") else "slash"
        self.clean = _HIDDEN[family].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.lines, self.clean_lines = text.split("\n"), self.clean.split("\n")
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def told(self, offset: int) -> bool:
        """Whether there is code at an offset, not a string or comment."""
        return self.clean[offset] == self.text[offset]

    def find(self, pattern: str) -> Iterator[re.Match]:
        """Matches in the text that begin in code."""
        return (m for m in re.finditer(pattern, self.text) if self.told(m.start() + len(m[0]) - len(m[0].lstrip()) if m[0].strip() else m.start()))

    @cached_property
    def closing(self) -> dict[int, int]:
        """Offset of each opening brace -> that of its closing one."""
        out, open_ = {}, []
        for m in re.finditer(r"[{}]", self.clean):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                out[open_.pop()] = m.start()
        return out

    @cached_property
    def indented_ends(self) -> list[int]:
        """For each line, the last line (from 0) of the block that is indented deeper than it."""
        out, open_, last = list(range(len(self.lines))), [], -1
        for i, line in enumerate(self.clean_lines):
            if not line.strip():
                if self.lines[i].strip() and open_ and len(self.lines[i]) - len(self.lines[i].lstrip()) > open_[-1][0]:
                    last = i  # a docstring line
                continue
            indent = len(line) - len(line.lstrip())
            while open_ and open_[-1][0] >= indent and not (open_[-1][0] == indent and line.lstrip().startswith(")")):
                out[open_.pop()[1]] = last
            if not (open_ and open_[-1][0] == indent):
                open_.append((indent, i))
            last = i
        for _, i in open_:
            out[i] = last
        return out

    @cached_property
    def ended(self) -> dict[int, int]:
        """Line (from 0) of each opening keyword's line -> line of its ``end``; keywords after a statement open nothing."""
        opener = {"ruby": r"(?:^|=|\()\s*(?:if|unless|while|until|for|case|begin)\b|\b(?:def|class|module|do)\b", "elixir": r"\bdo\b(?!:)", "lua": r"\b(?:function|do|then|repeat)\b"}[self.lang]
        out, open_ = {}, []
        for i, line in enumerate(self.clean_lines):
            events = sorted([(m.start(), 1) for m in re.finditer(opener, line)] + [(m.start(), 0) for m in re.finditer(r"(?<![.\w:])(?:end|until)\b" if self.lang == "lua" else r"(?<![.\w:])end\b", line)])
            if self.lang == "ruby" and re.match(r"\s*(?:while|until|for)\b.*\bdo\b", line):
                events = events[1:]
            for _, opens in events:
                if opens:
                    open_.append(i)
                elif open_:
                    at = open_.pop()
                    out.setdefault(at, i)
        return out

    @cached_property
    def definitions(self) -> list[Definition]:
        out, seen = [], set()
        for kind, pattern in DEFINES.get(self.lang, GENERIC):
            for m in re.finditer(pattern, self.clean):
                start, name = m.start() + len(m[0]) - len(m[0].lstrip()), self.text[m.start("n") : m.end("n")]
                line = self.line(m.start("n"))
                if (name in CONTROL and (self.lang in SCRIPT or self.lang not in DEFINES)) or (line, name) in seen:
                    continue
                opened = end = m.end()
                if self.lang in INDENTED:
                    last = self.indented_ends[line - 1]
                    end = self.starts[last] + len(self.lines[last])
                    opened = min(end, self.starts[line - 1] + len(self.lines[line - 1]) + 1)
                elif self.lang in ENDED:
                    last = self.ended.get(line - 1, line - 1)
                    end = self.starts[last] + len(self.lines[last])
                    opened = min(end, self.starts[line - 1] + len(self.lines[line - 1]) + 1)
                else:
                    brace = self.block(m.end())
                    if brace is None and kind in FUNCTIONS and not m[0].rstrip().endswith("=>") and self.lang not in SCRIPT | {"rust"}:
                        continue
                    if brace is not None:
                        opened, end = brace + 1, self.closing[brace]
                    else:
                        stop = re.compile(r";|\n(?!\s*[|&?:.=])").search(self.clean, m.end())
                        end = stop.start() if stop else len(self.clean)
                seen.add((line, name))
                out.append(Definition(kind, name, start, opened, end, line, self.line(max(start, end))))
        return sorted(out, key=lambda d: (d.line, d.start))

    def block(self, after: int) -> int | None:
        """The brace that opens the block of a definition: outside of parentheses, before the statement ends."""
        depth = 0
        for m in re.compile(r"[(){};\[\]\n]").finditer(self.clean, after):
            if m[0] == "\n":
                if self.lang == "go" and not depth:
                    return None
            elif m[0] in "([":
                depth += 1
            elif m[0] in ")]":
                depth -= 1
                if depth < 0:
                    return None
            elif m[0] == "{" and not depth:
                return m.start() if m.start() in self.closing else None
            elif (m[0] == ";" or m[0] == "}") and not depth:
                return None
        return None

    @cached_property
    def parents(self) -> list[Definition | None]:
        """The innermost definition around each."""
        out, open_ = [], []
        for d in self.definitions:
            while open_ and open_[-1].end <= d.start:
                open_.pop()
            out.append(open_[-1] if open_ else None)
            open_.append(d)
        return out


def functions_of(source: Source) -> Iterator[tuple]:
    """name, signature, line, end_line, body."""
    for d in source.definitions:
        if d.kind in FUNCTIONS:
            if source.lang in INDENTED | ENDED:
                signature, body = source.lines[d.line - 1].strip().rstrip(":"), "\n".join(source.lines[d.line : d.end_line])
            else:
                signature, body = " ".join(source.text[d.start : d.opened].split()).removesuffix("{").rstrip(), source.text[d.opened : d.end]
            yield d.name, signature, d.line, d.end_line, body


def symbols_of(source: Source) -> Iterator[tuple]:
    """kind, name, line, end_line, parent."""
    for d, around in zip(source.definitions, source.parents, strict=True):
        if not (d.kind == "method" and source.lang in SCRIPT and (around is None or around.kind != "class")):
            yield d.kind, d.name, d.line, d.end_line, around.name if around else None


def snippets_of(source: Source) -> Iterator[tuple]:
    """name, qualified, kind, line, end_line, text: whole definitions."""
    for kind, name, line, end_line, around in symbols_of(source):
        yield name, f"{around}.{name}" if around else name, kind, line, end_line, "\n".join(source.lines[line - 1 : end_line])


_JS_IMPORTS = (
    ("static", r"\bimport\s+(?:type\s+)?(?P<b>[^'\";()]+?)\s+from\s+['\"](?P<s>[^'\"]+)['\"]"),
    ("side-effect", r"\bimport\s+['\"](?P<s>[^'\"]+)['\"]"),
    ("re-export", r"\bexport\s+(?:type\s+)?(?P<b>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['\"](?P<s>[^'\"]+)['\"]"),
    ("dynamic", r"\bimport\(\s*['\"](?P<s>[^'\"]+)['\"]"),
    ("require", r"(?:\b(?:const|let|var)\s+(?P<b>\{[^}]*\}|[\w$]+)\s*=\s*)?\brequire\(\s*['\"](?P<s>[^'\"]+)['\"]"),
)
_IMPORTS = {
    "javascript": _JS_IMPORTS,
    "typescript": _JS_IMPORTS,
    "python": (("static", r"(?m)^[ \t]*from[ \t]+(?P<s>[\w.]+)[ \t]+import[ \t]+(?P<b>\([^)]*\)|[^\n#;]+)"), ),
    "go": (("static", r"(?m)^import\s+(?P<b>[\w.]+\s+)?\"(?P<s>[^\"]+)\""),),
    "rust": (("static", r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<s>[\w:]+?)(?:::(?P<b>\{[^}]*\}|\*))?\s*(?:as\s+\w+\s*)?;"), ("module", r"(?m)^[ \t]*(?:pub\s+)?mod\s+(?P<s>\w+)\s*;")),
    "ruby": (("static", r"(?m)^[ \t]*require\s+['\"](?P<s>[^'\"]+)['\"]"), ("relative", r"(?m)^[ \t]*require_relative\s+['\"](?P<s>[^'\"]+)['\"]")),
    "c": (("static", r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"](?P<s>[^>\"]+)[>\"]"),),
}
_IMPORTS["cpp"] = _IMPORTS["c"]
_GENERIC_IMPORTS = (("static", r"(?m)^[ \t]*(?:import|use|using|require|include)\s+(?:static\s+)?['\"<]?(?P<s>[\w.:/\\*-]+)"),)


def bound(clause: str | None) -> list[str]:
    """Local names that an import clause binds; ``*`` for whole modules."""
    if not clause:
        return []
    flat = re.sub(r"\*\s+as\s+", "*", clause.strip().strip("()"))
    names = [re.split(r"\s+as\s+|\s*:\s*", x.strip())[-1].removeprefix("type ") for x in re.split(r"[{},]", flat)]
    return [("*" if x.startswith("*") else x).split("::")[-1] for x in names if x]


def imports_of(source: Source) -> Iterator[tuple]:
    """spec, line, kind, bindings."""
    found = [(m["s"], source.line(m.start("s")), kind, bound(m.groupdict().get("b"))) for kind, pattern in _IMPORTS.get(source.lang, _GENERIC_IMPORTS) for m in source.find(pattern)]
    if source.lang == "python":
        for m in source.find(r"(?m)^[ \t]*import[ \t]+(?P<all>[\w., \t]+)"):
            found += [(x[1], source.line(m.start("all")), "static", [x[2]] if x[2] else []) for x in re.finditer(r"([\w.]+)(?:[ \t]+as[ \t]+(\w+))?", m["all"])]
    if source.lang == "go":
        for block in source.find(r"(?m)^import\s*\((?P<all>[^)]*)\)"):
            found += [(m[2], source.line(block.start("all") + m.start(2)), "static", [m[1].strip()] if m[1] else []) for m in re.finditer(r"([\w.]+\s+)?\"([^\"]+)\"", block["all"])]
    yield from sorted(set((s, n, k, tuple(b)) for s, n, k, b in found), key=lambda x: (x[1], x[0], x[2]))


def exports_of(source: Source) -> Iterator[tuple]:
    """name, line, kind."""
    top = [d for d, around in zip(source.definitions, source.parents, strict=True) if around is None]
    if source.lang in SCRIPT:
        out = [(m[2], source.line(m.start(2)), m[1]) for m in source.find(rf"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\s*\*?\s+({NAME})")]
        for m in source.find(r"\bexport\s*(?:type\s*)?\{([^}]*)\}"):
            out += [(re.split(r"\s+as\s+", x.strip())[-1], source.line(m.start()), "list") for x in m[1].split(",") if x.strip()]
        out += [(m[1] or "*", source.line(m.start()), "star") for m in source.find(rf"\bexport\s*\*(?:\s*as\s+({NAME}))?\s+from\b")]
        out += [("default", source.line(m.start()), "default") for m in source.find(r"\bexport\s+default\s+(?!(?:async\s+)?function\b|(?:abstract\s+)?class\b)")]
        out += [(m[1] or "default", source.line(m.start()), "commonjs") for m in source.find(rf"(?m)^[ \t]*(?:module\.)?exports(?:\.({NAME}))?\s*=(?!=)")]
    elif source.lang == "python":
        listed = re.search(r"(?ms)^__all__\s*=\s*[\[(](.*?)[\])]", source.text)
        if listed:
            line = source.line(listed.start())
            out = [(m[1], line, "list") for m in re.finditer(r"['\"](\w+)['\"]", listed[1])]
        else:
            out = [(d.name, d.line, d.kind) for d in top if not d.name.startswith("_")] + [(m[1], source.line(m.start()), "const") for m in source.find(r"(?m)^([A-Z][A-Z0-9_]*)\s*(?::[^=\n]+)?=(?!=)")]
    elif source.lang == "go":
        out = [(d.name, d.line, d.kind) for d in top if d.name[:1].isupper()]
    elif source.lang == "rust":
        out = [(d.name, d.line, d.kind) for d in source.definitions if source.lines[d.line - 1].lstrip().startswith("pub ") and d.kind != "impl"]
    elif source.lang == "ruby":
        private = next((i for i, x in enumerate(source.clean_lines) if x.strip() == "private"), len(source.lines))
        out = [(d.name, d.line, d.kind) for d in source.definitions if d.kind != "function" or d.line - 1 < private]
    else:
        out = [(d.name, d.line, d.kind) for d in top]
    yield from sorted(set(out), key=lambda x: (x[1], x[0]))


def calls_of(source: Source) -> Iterator[tuple]:
    """caller, callee, line: calls inside of functions, of the innermost one."""
    own = [d for d in source.definitions if d.kind in FUNCTIONS]
    named = {source.text.index(d.name, d.start) for d in own}
    at, open_ = 0, []
    for m in re.finditer(rf"(?<![\w$.])({NAME})\s*\(", source.clean):
        while at < len(own) and own[at].start <= m.start():
            while open_ and open_[-1].end <= own[at].start:
                open_.pop()
            open_.append(own[at])
            at += 1
        while open_ and open_[-1].end <= m.start():
            open_.pop()
        if open_ and m.start(1) not in named and m[1] not in CONTROL and m[1] not in ("async", "def", "func", "fn", "fun", "sub", "proc"):
            yield open_[-1].name, m[1], source.line(m.start())


def comment_above(source: Source, line: int) -> int:
    """The first line (from 1) of the comment that ends right above a line, or the line itself."""
    at = line - 1
    while at > 0 and source.lines[at - 1].strip() and not source.clean_lines[at - 1].strip():
        at -= 1
    return at + 1


def types_of(source: Source) -> Iterator[tuple]:
    """kind, name, exported, line, end_line, definition (with the comment above it)."""
    for d in source.definitions:
        if d.kind in ("interface", "type", "enum", "struct", "trait"):
            exported = source.lines[d.line - 1].lstrip().startswith(("export ", "pub ")) or (source.lang == "go" and d.name[:1].isupper())
            yield d.kind, d.name, exported, d.line, d.end_line, "\n".join(source.lines[comment_above(source, d.line) - 1 : d.end_line])


_TAG = re.compile(r"^@(\w+)\s*(.*)$")
_SECTION = re.compile(r"^(Args|Arguments|Parameters|Returns|Return|Raises|Yields):\s*$")


def tags(comment: str, python: bool) -> tuple[str, list[str]]:
    """A doc comment's text and its tags, each as ``tag rest``: @tags, or entries of a docstring's sections."""
    said, found, section = [], [], None
    for line in comment.split("\n"):
        t = line.strip() if python else re.sub(r"^\s*(?:/\*\*?|\*/|\*|///?!?|#)\s?|\s*\*/\s*$", "", line).strip()
        if python and (m := _SECTION.match(t)):
            section = m[1].lower().rstrip("s").replace("argument", "arg").replace("parameter", "arg")
        elif section and t and line.startswith((" ", "\t")):
            found.append(f"{section} {t}")
        elif not python and (m := _TAG.match(t)):
            found.append(" ".join([m[1], m[2]]).strip())
        elif t and not found:
            said.append(t)
        elif found and t:
            found[-1] += " " + t
    return " ".join(said), found


def docs_of(source: Source) -> Iterator[tuple]:
    """name, kind, line, text, tags of top-level declarations and methods; text is null where nothing documents them."""
    for d, around in zip(source.definitions, source.parents, strict=True):
        if around is not None and around.kind not in ("class", "struct", "impl", "trait", "module", "interface"):
            continue
        comment = None
        if source.lang == "python":
            if m := re.compile(r"\s*(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3})", re.S).match(source.text, d.opened, d.end):
                comment = m[1] or m[2]
        elif (first := comment_above(source, d.line)) < d.line:
            comment = "\n".join(source.lines[first - 1 : d.line - 1])
        said, found = tags(comment, source.lang == "python") if comment is not None else (None, [])
        yield d.name, d.kind, d.line, said, found


_VERBS = "get|post|put|patch|delete|head|options|all"


def endpoints_of(source: Source) -> Iterator[tuple]:
    """method, path, line, handler, framework: routes called on an application, decorators, exported verbs."""

    def next_name(line: int) -> str:
        for text in source.lines[line : line + 4]:
            if not text.strip().startswith("@") and (m := re.search(r"(\w+)\s*\(", text)):
                return m[1]
        return ""

    out = []
    for m in source.find(rf"\.({_VERBS})\s*\(\s*['\"`]([^'\"`]+)['\"`]([^\n]*)"):
        named = re.search(r",\s*(\w+)\s*\)", m[3])
        handler = named[1] if named and named[1] not in ("req", "res", "ctx", "c", "request", "response") else "(inline)" if re.search(r",\s*(?:async\s+)?\(.*?\)\s*=>", m[3]) else ""
        out.append((m[1].upper(), m[2], source.line(m.start()), handler, "call"))
    for m in source.find(r"@(?:\w+\.)?(Get|Post|Put|Patch|Delete|Head|Options|All|get|post|put|patch|delete|route)\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?[^)\n]*\)"):
        out.append((m[1].upper(), m[2] or "/", source.line(m.start()), next_name(source.line(m.start())), "decorator"))
    for m in source.find(r"\bexport\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\("):
        out.append((m[1], "(from filename)", source.line(m.start()), m[1], "file"))
    taken = {(x[0], x[2]) for x in out if x[4] == "decorator"}
    yield from sorted((x for x in out if x[4] != "call" or (x[0], x[2]) not in taken), key=lambda x: (x[2], x[0]))


def operations_of(source: Source) -> Iterator[tuple]:
    """type, name, line, source of GraphQL operations: fields of Query, Mutation and Subscription in schemas and resolvers, and decorators."""
    for m in re.finditer(r"(?m)\b(?:(?:extend\s+)?type\s+(Query|Mutation|Subscription)\s*|(Query|Mutation|Subscription)\s*:\s*)\{", source.text):
        depth, at = 1, m.end()
        for line in source.text[m.end() :].split("\n"):
            field = re.match(r"\s*(?:async\s+)?(\w+)\s*(?:\([^)]*\))?\s*[:({]", line)
            if depth == 1 and field and not line.strip().startswith("#"):
                yield m[1] or m[2], field[1], source.line(at + field.start(1)), "schema" if m[1] else "resolver"
            depth += line.count("{") - line.count("}")
            at += len(line) + 1
            if depth <= 0:
                break
    for m in source.find(r"@(Query|Mutation|Subscription)\s*\([^\n]*\)\s*\n\s*(?:async\s+)?(\w+)\s*\("):
        yield m[1], m[2], source.line(m.start()), "decorator"


def components_of(source: Source) -> Iterator[tuple]:
    """name, line, props, hooks, state, children: components are capitalised functions that return markup."""
    for d in source.definitions:
        body, head = source.text[d.opened : d.end], source.text[d.start : d.opened]
        if d.kind not in FUNCTIONS or not d.name[:1].isupper() or not re.search(r"<[A-Za-z>]", body):
            continue
        shown = re.search(r"\(\s*\{([^}]*)\}", head)
        props = [re.split(r"[:=]", x.strip())[0].strip() for x in shown[1].split(",") if x.strip()] if shown else []
        hooks = sorted(set(re.findall(r"\b(use[A-Z]\w*)\s*\(", body)))
        state = re.findall(r"\[\s*(\w+)\s*,\s*\w+\s*\]\s*=\s*useState\b", body)
        yield d.name, d.line, props, hooks, state, sorted(set(re.findall(r"<([A-Z][\w.]*)", body)))


def errors_of(source: Source) -> Iterator[tuple]:
    """kind (class, throw, catch, reject), type, line."""
    out = [("class", m[1], m.start()) for m in source.find(r"\bclass\s+(\w+)\s+extends\s+\w*Error\b")] + [("class", m[1], m.start()) for m in source.find(r"(?m)^[ \t]*class\s+(\w+)\s*\(\w*(?:Error|Exception)\)")]
    out += [("throw", m[1] or "Untyped", m.start()) for m in source.find(r"\bthrow\s+(?:new\s+(\w+)\s*\()?")] + [("throw", m[1], m.start()) for m in source.find(r"(?m)^[ \t]*raise\s+(\w+)")]
    out += [("catch", m[1], m.start()) for m in source.find(r"\bcatch\s*(?:\(\s*(\w+)[^)]*\)\s*)?\{")] + [("catch", m[1], m.start()) for m in source.find(r"(?m)^[ \t]*(?:except|rescue)\b[ \t]*(\w+)?")]
    out += [("reject", None, m.start()) for m in source.find(r"\breject\s*\(|\bPromise\.reject\b")]
    yield from sorted(((k, t, source.line(at + len(source.text[at:]) - len(source.text[at:].lstrip()))) for k, t, at in out), key=lambda x: (x[2], x[0]))


def schema_of(source: Source) -> Iterator[tuple]:
    """format, table, field, type: SQL migrations in order (a later CREATE replaces, ALTER adds), Prisma models, table builders, entity classes."""
    tables: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for m in re.finditer(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)[\"`\]]?\s*\((.*?)\)\s*;|\balter\s+table\s+(?:only\s+)?[\"`]?([\w.]+)[\"`]?\s+add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?[\"`]?(\w+)[\"`]?\s+([\w() ,]+?)\s*;", source.text):
        if m[1]:
            rows = [re.match(r"\s*[\"`\[]?(\w+)[\"`\]]?\s+([A-Za-z]+(?:\s*\([\d, ]+\))?)", x) for x in re.split(r",(?![^(]*\))", m[2])]
            tables["sql", m[1]] = [(r[1], re.sub(r"\s+", "", r[2]).lower()) for r in rows if r and r[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key", "index")]
        else:
            tables.setdefault(("sql", m[3]), []).append((m[4], m[5].split()[0].lower()))
    for m in re.finditer(r"(?m)^model\s+(\w+)\s*\{([^}]*)\}", source.text):
        tables["prisma", m[1]] = re.findall(r"(?m)^[ \t]+(\w+)[ \t]+(\w+(?:\[\]|\?)?)", m[2])
    for m in re.finditer(r"\b(?:pg|mysql|sqlite)Table\(\s*['\"](\w+)['\"]\s*,\s*\{(.*?)\n\}", source.text, re.S):
        tables["drizzle", m[1]] = re.findall(r"(?m)^\s*(\w+)\s*:\s*(\w+)\s*\(", m[2])
    for m in re.finditer(r"@Entity\([^)]*\)\s*(?:export\s+)?class\s+(\w+)[^{]*\{(.*?)\n\}", source.text, re.S):
        tables["typeorm", m[1]] = re.findall(r"@\w*Column\([^)]*\)\s*(\w+)[!?]?\s*:\s*([\w\[\]]+)", m[2])
    for m in re.finditer(r"\b(\w+)\s*=\s*new\s+(?:mongoose\.)?Schema\(\s*\{(.*?)\n\}", source.text, re.S):
        tables["mongoose", m[1]] = re.findall(r"(?m)^\s*(\w+)\s*:\s*(?:\{\s*type\s*:\s*)?(\w+)", m[2])
    for (form, name), fields in tables.items():
        yield from ((form, name, field, kind) for field, kind in fields)


def manifest_of(source: Source) -> Iterator[tuple]:
    """section, name, version of what a manifest depends on; the format follows from ``lang`` (the file's name)."""
    import json

    if source.lang == "package.json":
        try:
            every = json.loads(source.text)
        except ValueError:
            return
        for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            yield from ((section, k, str(v)) for k, v in (every.get(section) or {}).items())
    elif source.lang == "go.mod":
        for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)", source.text):
            yield "require", m[1], m[2]
    elif source.lang == "requirements.txt":
        for m in re.finditer(r"(?m)^([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===)[^#\n;]*)?", source.text):
            yield "requirements", m[1].lower(), (m[2] or "").strip()
    elif source.lang == "Cargo.toml":
        for block in re.finditer(r"(?m)^\[((?:dev-|build-)?dependencies)\]\n((?:(?!\[).*\n?)*)", source.text):
            yield from ((block[1], m[1], m[2]) for m in re.finditer(r"(?m)^([\w-]+)\s*=\s*(?:\{[^}\n]*?version\s*=\s*)?\"([^\"]*)\"", block[2]))
    elif source.lang == "docker-compose.yml":
        for m in re.finditer(r"(?m)^\s+image:\s*['\"]?([^\s:'\"]+)(?::([^\s'\"]+))?", source.text):
            yield "image", m[1], m[2] or "latest"


#: Pieces of a shell command: what is taken whole, what nests, what joins segments on the top level, what no chain holds there, what is left open.
_SHELL = re.compile(r"""(?P<whole>\\.|'[^']*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<opens>\$?\()|(?P<closes>\))|(?P<joins>&&|\|\||;)|(?P<refused><<|&|\{(?=\s|$))|(?P<broken>['"`\\])|(?P<plain>[^\\'"`$();&|<{]+|.)""", re.S)


def chains_of(source: Source) -> Iterator[tuple]:
    """nth, operator before, segment of a shell command that is a chain of && || and ; on its top level; nothing for any other."""
    depth, ops, segments = 0, [""], [[]]
    for piece in _SHELL.finditer(source.text):
        kind = piece.lastgroup
        if kind == "broken" or (kind == "refused" and not depth):
            return
        if kind == "joins" and not depth:
            ops.append(piece[0])
            segments.append([])
            continue
        depth = depth + 1 if kind == "opens" else max(0, depth - 1) if kind == "closes" else depth
        segments[-1].append(piece[0])
    said = ["".join(x).strip() for x in segments]
    if len(said) > 1 and all(said) and not depth:
        yield from zip(range(len(said)), ops, said, strict=True)


SCANS: dict[str, tuple[Callable[[Source], Iterator[tuple]], str]] = {
    "functions": (functions_of, "name string, signature string, line int, end_line int, body string"),
    "symbols": (symbols_of, "kind string, name string, line int, end_line int, parent string"),
    "snippets": (snippets_of, "name string, qualified string, kind string, line int, end_line int, text string"),
    "imports": (imports_of, "spec string, line int, kind string, bindings array<string>"),
    "exports": (exports_of, "name string, line int, kind string"),
    "calls": (calls_of, "caller string, callee string, line int"),
    "types": (types_of, "kind string, name string, exported boolean, line int, end_line int, definition string"),
    "docs": (docs_of, "name string, kind string, line int, doc string, tags array<string>"),
    "endpoints": (endpoints_of, "method string, route string, line int, handler string, framework string"),
    "operations": (operations_of, "type string, name string, line int, source string"),
    "components": (components_of, "name string, line int, props array<string>, hooks array<string>, state array<string>, children array<string>"),
    "errors": (errors_of, "kind string, type string, line int"),
    "schema": (schema_of, "format string, table string, field string, type string"),
    "manifest": (manifest_of, "section string, name string, version string"),
    "chains": (chains_of, "nth int, op string, segment string"),
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def scan(files: DataFrame, what: str, path: str = "path", content: str = "content", lang: str = "lang") -> DataFrame:
    """One row per finding in each file: path, lang and the columns of SCANS[what]. Null content has none."""
    finder, columns = SCANS[what]
    fields = [("path", pa.string()), ("lang", pa.string())] + [(c.split()[0], _ARROW[c.split()[1]]) for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [(p, g, *found) for p, g, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for found in finder(Source(text or "", g or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return files.select(F.col(path).cast("string"), F.col(lang).cast("string"), F.col(content).cast("string")).mapInArrow(run, f"path string, lang string, {columns}")


def snippets(files: DataFrame, wanted: str) -> DataFrame:
    """Whole definitions of a name, of ``Class.name``, or of either in files whose path ends in what stands before a colon."""
    file, _, name = wanted.rpartition(":")
    found = scan(files, "snippets")
    found = found.where((F.col("name") == name) | (F.col("qualified") == name))
    return found.where(F.col("path").endswith(file)) if file else found


def scope_at(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """path, line, scope: the names of the definitions around each asked line (columns path, at), outermost first."""
    around = lines.join(symbols.select("path", "name", "line", "end_line"), "path").where(F.col("at").between(F.col("line"), F.col("end_line")))
    inner = around.groupBy("path", "at").agg(F.sort_array(F.collect_list(F.struct("line", "name"))).alias("scope"))
    return inner.select("path", "at", F.array_join(F.col("scope.name"), " > ").alias("scope"))


def fast_names(files: DataFrame, content: str = "content") -> DataFrame:
    """path, name of what looks like a function, without reading blocks (built-in expressions only)."""
    pattern = rf"(?m)(?:\b(?:function|func|fn|def)\s+(?:\([^)]*\)\s*)?(?:self[.])?|\b(?:const|let|var)\s+(?=[\w$]+\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>))({NAME})"
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))).alias("name"))


def by_kind(symbols: DataFrame, *kinds: str) -> DataFrame:
    return symbols.where(F.col("kind").isin(*kinds)) if kinds else symbols


def counted(symbols: DataFrame) -> DataFrame:
    """path, symbols: all of a file, members of members too."""
    return symbols.groupBy("path").agg(F.count("*").alias("symbols"))


def first_lines(found: DataFrame, key: list[str], n: int = 3) -> DataFrame:
    """The first findings of each key, by line."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy("path", "line"))
    return found.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")
