"""A project of source files made from the ``part`` table, a file per part in one of six languages, with what every scanner must find in it.

A template's ``~x~`` stands for a column: k the part's key, h the part whose file it imports, d and g their
folders, s the size, e the key modulo five. The same template gives the Spark column and the SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import read

ENDINGS = ("js", "ts", "py", "go", "rs", "rb")
LANGUAGES = ("javascript", "typescript", "python", "go", "rust", "ruby")
TEMPLATES = (
    """import { f~h~ } from '../d~g~/m~h~';
import fs from 'fs';
import * as lib from 'lib~e~';
/**
 * Sums up ~s~.
 * @param a thing ~k~
 */
export function f~k~(a, b = ~s~) {
  // TODO: check size ~s~
  if (a && b) {
    return f~h~(a);
  }
  return "}{" + fs;
}
export class C~k~ extends Base {
  run(x) {
    try { return f~k~(x); } catch (e) { throw new E~e~Error("x"); }
  }
}
const hidden~k~ = (x) => {
  return lib.go(x, { a: 1, b: 2 });
};
app.get('/p/~k~', f~k~);
export { hidden~k~ as shown~k~ };
""",
    """import type { T~h~ } from '../d~g~/m~h~';
/** A thing of size ~s~. */
export interface T~k~ extends Base {
  size: { n: number };
}
type U~k~ = 'a' | 'b~s~';
export enum E~k~ { P, Q~e~ }
export const f~k~ = async (a: string): Promise<void> => {
  // FIXME(@ana): broken for size ~s~
  return g~k~(a);
};
@Controller('c~k~')
export class K~k~ {
  @Get('/t~e~')
  async find~k~(id: string): Promise<T~k~> {
    return this.store(id);
  }
}
export function View~k~({ size, name = 'x' }) {
  const [n, setN] = useState(~s~);
  return <Box~e~ size={n}><T /></Box~e~>;
}
""",
    '''import os
from src.d~g~.m~h~ import f~h~ as other

class C~k~(Base):
    """Keeps ~s~.

    Args:
        x: the thing ~k~
    """
    def load(self, key):
        return f~k~(key)

def f~k~(key):
    # TODO: sort by ~s~
    if key:
        raise E~e~Error("x")
    return other(key)

def _hidden~k~():
    return os.getenv("V~e~")
''',
    """package d~d~

import (
	"fmt"
	m "src/d~g~/m~h~"
)

type S~k~ struct {
	Size int
}

// Run~k~ runs ~s~.
func (s *S~k~) Run~k~(a int) error {
	return f~k~(a)
}

func f~k~(a int) error {
	fmt.Println("}", ~s~)
	return m.F~h~(a)
}
""",
    """use crate::d~g~::m~h~::{fmt, io};
mod inner~k~;
/// Holds ~s~.
pub struct S~k~<'a> {
    x: &'a str,
}
impl<'a> S~k~<'a> {
    pub fn show~k~(&self) -> String {
        let c = '{'; f~k~(self.x)
    }
}
fn f~k~(a: &str) -> String {
    format(a, ~s~)
}
""",
    """require 'set'
require_relative '../d~g~/m~h~'
module M~k~
  class C~k~ < Base
    # Goes ~s~ times.
    def self.go~k~(x)
      return ~s~ if x.nil?
      x.each do |y|
        f~k~(y)
      end
    end
    private
    def f~k~(y)
      puts "end"
    end
  end
end
""",
)
#: Tests of some files: beside the TypeScript ones, in a folder of their own for the JavaScript ones.
TESTS = (("k % 12 = 0", "tests/m~k~.test.js", "import { f~k~ } from '../src/d~d~/m~k~';\ntest('x', () => { expect(f~k~(1)).toBe(~s~); });\n"), ("k % 30 = 1", "src/d~d~/m~k~.test.ts", "import { f~k~, K~k~ } from './m~k~';\nit('y', () => { expect(new K~k~()).toBe(~s~); });\n"))
PATH = "src/d~d~/m~k~."
_ROWS = "(SELECT p_partkey AS k, greatest(p_partkey // 2, 1) AS h, p_partkey % 10 AS d, greatest(p_partkey // 2, 1) % 10 AS g, p_size AS s, p_partkey % 5 AS e FROM part)"


def fill(template: str) -> Column:
    return F.concat(*(F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(re.split("~(.)~", template)) if x))


def fill_sql(template, other: str = "") -> str:
    """The SQL expression of a template (a string with ``~x~``; anything else is a literal). other: a suffix of column names."""
    if template is None:
        return "NULL"
    if isinstance(template, bool):
        return str(template).lower()
    if isinstance(template, int):
        return f"{template}::INT"
    if isinstance(template, (list, tuple)):
        return f"[{', '.join(fill_sql(x) for x in template)}]::VARCHAR[]"
    return " || ".join(f"{x}{other}" if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(re.split("~(.)~", template)) if x) or "''"


def rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    half = F.greatest(F.floor(key / 2), F.lit(1))
    return read(spark, d, "part").select(key.alias("k"), half.alias("h"), (key % 10).alias("d"), (half % 10).alias("g"), F.col("p_size").alias("s"), (key % 5).alias("e"))


def files(spark: SparkSession, d: str, tests: bool = False) -> DataFrame:
    """path, lang, content of the project."""
    own, kind = rows(spark, d), F.col("k") % len(TEMPLATES)
    pick = lambda values: F.element_at(F.array(*values), (kind + 1).cast("int"))
    content = F.coalesce(*(F.when(kind == i, fill(t)) for i, t in enumerate(TEMPLATES)))
    out = own.select(F.concat(fill(PATH), pick([F.lit(x) for x in ENDINGS])).alias("path"), pick([F.lit(x) for x in LANGUAGES]).alias("lang"), content.alias("content"))
    for condition, path, text in TESTS if tests else ():
        out = out.unionByName(own.where(condition).select(fill(path).alias("path"), F.lit("typescript" if path.endswith("ts") else "javascript").alias("lang"), fill(text).alias("content")))
    return out


def path_sql(key: str = "k") -> str:
    """The path of the file of a part."""
    ending = "[" + ", ".join(f"'{x}'" for x in ENDINGS) + "]"
    return f"'src/d' || {key} % 10 || '/m' || {key} || '.' || {ending}[{key} % {len(ENDINGS)} + 1]"


def expected(columns: str, facts: dict[int, list[tuple]], where: str = "true") -> str:
    """SQL of path and ``columns``: the facts of each language, one row a fact and file."""
    names = columns.split(", ")
    parts = [f"SELECT {path_sql()} AS path, " + ", ".join(f"{fill_sql(v)} AS {n}" for n, v in zip(names, fact, strict=True)) + f" FROM {_ROWS} WHERE k % {len(TEMPLATES)} = {kind} AND {where}" for kind, found in facts.items() for fact in found]
    return " UNION ALL ".join(parts)


#: kind, name, line, end_line, parent of every symbol.
SYMBOLS = {
    0: [("function", "f~k~", 8, 14, None), ("class", "C~k~", 15, 19, None), ("method", "run", 16, 18, "C~k~"), ("function", "hidden~k~", 20, 22, None)],
    1: [("interface", "T~k~", 3, 5, None), ("type", "U~k~", 6, 6, None), ("enum", "E~k~", 7, 7, None), ("function", "f~k~", 8, 11, None), ("class", "K~k~", 13, 18, None), ("method", "find~k~", 15, 17, "K~k~"), ("function", "View~k~", 19, 22, None)],
    2: [("class", "C~k~", 4, 11, None), ("function", "load", 10, 11, "C~k~"), ("function", "f~k~", 13, 17, None), ("function", "_hidden~k~", 19, 20, None)],
    3: [("struct", "S~k~", 8, 10, None), ("method", "Run~k~", 13, 15, None), ("function", "f~k~", 17, 20, None)],
    4: [("module", "inner~k~", 2, 2, None), ("struct", "S~k~", 4, 6, None), ("impl", "S~k~", 7, 11, None), ("function", "show~k~", 8, 10, "S~k~"), ("function", "f~k~", 12, 14, None)],
    5: [("module", "M~k~", 3, 17, None), ("class", "C~k~", 4, 16, "M~k~"), ("function", "go~k~", 6, 11, "C~k~"), ("function", "f~k~", 13, 15, "C~k~")],
}
#: spec, line, kind, bindings of every import.
IMPORTS = {
    0: [("../d~g~/m~h~", 1, "static", ["f~h~"]), ("fs", 2, "static", ["fs"]), ("lib~e~", 3, "static", ["*"])],
    1: [("../d~g~/m~h~", 1, "static", ["T~h~"])],
    2: [("os", 1, "static", []), ("src.d~g~.m~h~", 2, "static", ["other"])],
    3: [("fmt", 4, "static", []), ("src/d~g~/m~h~", 5, "static", ["m"])],
    4: [("crate::d~g~::m~h~", 1, "static", ["fmt", "io"]), ("inner~k~", 2, "module", [])],
    5: [("set", 1, "static", []), ("../d~g~/m~h~", 2, "relative", [])],
}
#: name, line, kind of every export.
EXPORTS = {
    0: [("f~k~", 8, "function"), ("C~k~", 15, "class"), ("shown~k~", 24, "list")],
    1: [("T~k~", 3, "interface"), ("E~k~", 7, "enum"), ("f~k~", 8, "const"), ("K~k~", 13, "class"), ("View~k~", 19, "function")],
    2: [("C~k~", 4, "class"), ("f~k~", 13, "function")],
    3: [("S~k~", 8, "struct"), ("Run~k~", 13, "method")],
    4: [("S~k~", 4, "struct"), ("show~k~", 8, "function")],
    5: [("M~k~", 3, "module"), ("C~k~", 4, "class"), ("go~k~", 6, "function")],
}
#: caller, callee, line of every call.
CALLS = {
    0: [("f~k~", "f~h~", 11), ("run", "f~k~", 17), ("run", "E~e~Error", 17)],
    1: [("f~k~", "g~k~", 10), ("View~k~", "useState", 20)],
    2: [("load", "f~k~", 11), ("f~k~", "E~e~Error", 16), ("f~k~", "other", 17)],
    3: [("Run~k~", "f~k~", 14)],
    4: [("show~k~", "f~k~", 9), ("f~k~", "format", 13)],
    5: [("go~k~", "f~k~", 9)],
}
TYPES = {
    1: [("interface", "T~k~", True, 3, 5, "/** A thing of size ~s~. */\nexport interface T~k~ extends Base {\n  size: { n: number };\n}"), ("type", "U~k~", False, 6, 6, "type U~k~ = 'a' | 'b~s~';"), ("enum", "E~k~", True, 7, 7, "export enum E~k~ { P, Q~e~ }")],
    3: [("struct", "S~k~", True, 8, 10, "type S~k~ struct {\n\tSize int\n}")],
    4: [("struct", "S~k~", True, 4, 6, "/// Holds ~s~.\npub struct S~k~<'a> {\n    x: &'a str,\n}")],
}
DOCS = {
    0: [("f~k~", 8, "Sums up ~s~.", ["param a thing ~k~"]), ("C~k~", 15, None, []), ("run", 16, None, []), ("hidden~k~", 20, None, [])],
    1: [("T~k~", 3, "A thing of size ~s~.", []), ("U~k~", 6, None, []), ("E~k~", 7, None, []), ("f~k~", 8, None, []), ("K~k~", 13, None, []), ("find~k~", 15, None, []), ("View~k~", 19, None, [])],
    2: [("C~k~", 4, "Keeps ~s~.", ["arg x: the thing ~k~"]), ("load", 10, None, []), ("f~k~", 13, None, []), ("_hidden~k~", 19, None, [])],
    3: [("S~k~", 8, None, []), ("Run~k~", 13, "Run~k~ runs ~s~.", []), ("f~k~", 17, None, [])],
    4: [("inner~k~", 2, None, []), ("S~k~", 4, "Holds ~s~.", []), ("S~k~", 7, None, []), ("show~k~", 8, None, []), ("f~k~", 12, None, [])],
    5: [("M~k~", 3, None, []), ("C~k~", 4, None, []), ("go~k~", 6, "Goes ~s~ times.", []), ("f~k~", 13, None, [])],
}
ENDPOINTS = {0: [("GET", "/p/~k~", 23, "f~k~", "call")], 1: [("GET", "/t~e~", 14, "find~k~", "decorator")]}
COMPONENTS = {1: [("View~k~", 19, ["size", "name"], ["useState"], ["n"], ["Box~e~", "T"])]}
ERRORS = {0: [("catch", "e", 17), ("throw", "E~e~Error", 17)], 2: [("throw", "E~e~Error", 16)]}
TODOS = {0: [("TODO", "check size ~s~", None, 9)], 1: [("FIXME", "broken for size ~s~", "ana", 9)], 2: [("TODO", "sort by ~s~", None, 14)]}
