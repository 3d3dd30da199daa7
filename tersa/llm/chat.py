r"""Operator 9: chat formatting with a grammar round trip.

Grammar of the rendered text, read left to right without look-back:

    conversation := turn*
    turn         := "[INST]" text "[/INST]"        user
                  | "<s>" text "</s>"              assistant, under the loss mask
                  | "<<SYS>>" text "<</SYS>>"      system
                  | "<<ROLE>>" role "<<:>>" text "<</ROLE>>"   any other role

A control string is one of these markers. In texts a marker is escaped by a backslash
after its first character; marker look-alikes that already have backslashes there get
one more, so unescaping takes exactly one away. Each turn is rendered plain first,
reparsed, and compared with its source; a turn that differs is rendered again with
its text escaped, and must then read back identical.

A conversation's rendered text is its turns' texts end to end. ``Reader`` parses it as a
whole, but takes it in pieces of any size: what a piece leaves unfinished waits for the
next. ``format_conversations`` gives the pieces with their place in the conversation and the
spans of the loss mask there; ``read_back`` reads the roles and texts from the rendered text,
and the text under the loss mask from those spans alone. Both stream through a
conversation in order, so nothing is gathered, however long it is. A digest of a whole
conversation is one running hash, so a conversation is one task's work.

Defined cases: null text or role is empty (an empty role is a role of its own); turns
of one conversation are ordered by turn (null first), role, text; repeated rows are
turns each; conversations with null conv_id form one conversation; extra columns are
dropped; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import partitions

#: role -> (opening, closing) marker.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
ROLE_END = "<<:>>"
CONTROL = sorted({*(m for pair in MARKS.values() for m in pair), *OTHER, ROLE_END}, key=len, reverse=True)
_MARK = re.compile("|".join(map(re.escape, CONTROL)))
#: A marker with any number of backslashes after its first character.
_LIKE = re.compile("|".join(re.escape(m[0]) + r"(\\*)" + re.escape(m[1:]) for m in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(m[0]) + r"\\(\\*)" + re.escape(m[1:]) for m in CONTROL))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _LIKE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def wrap(role: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + text + MARKS[role][1]
    return OTHER[0] + escape(role) + ROLE_END + text + OTHER[1]


class Broken(ValueError):
    """A text that the grammar doesn't generate."""


OPENINGS = {pair[0]: role for role, pair in MARKS.items()} | {OTHER[0]: None}


def first_turn(rendered: str) -> tuple[str, str, int, int, int] | None:
    """role, text, start and end of the raw text between its markers, and the turn's end; None if it isn't complete."""
    mark = _MARK.match(rendered)
    if not mark or mark[0] not in OPENINGS:
        if any(m.startswith(rendered) for m in OPENINGS):
            return None
        raise Broken(f"no turn opens at {rendered[:20]!r}")
    role, start = OPENINGS[mark[0]], mark.end()
    closing = OTHER[1] if role is None else MARKS[role][1]
    if role is None:
        end = _MARK.search(rendered, start)
        if not end:
            return None
        if end[0] != ROLE_END:
            raise Broken("a role doesn't end")
        role, start = unescape(rendered[start : end.start()]), end.end()
    end = _MARK.search(rendered, start)
    if not end:
        return None
    if end[0] != closing:
        raise Broken(f"{end[0]} stands where {closing} should")
    return role, unescape(rendered[start : end.start()]), start, end.start(), end.end()


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; the span is that of the raw text between its markers."""
    reader = Reader()
    out = list(reader.feed(rendered))
    reader.close()
    return out


class Reader:
    """Turns of a rendered conversation that arrives in pieces."""

    def __init__(self):
        self.rest, self.at = "", 0

    def feed(self, piece: str):
        """(role, text, start, end) of every turn that is complete now; spans count from the conversation's start."""
        self.rest += piece
        while found := first_turn(self.rest):
            role, text, start, end, after = found
            yield role, text, self.at + start, self.at + end
            self.rest, self.at = self.rest[after:], self.at + after

    def close(self) -> None:
        if self.rest:
            raise Broken(f"no turn opens or closes after {self.at}")


def render(role: str, text: str) -> str:
    """The turn, plain if it reads back identical and escaped otherwise."""
    for tried in (text, escape(text)):
        out = wrap(role, tried)
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except Broken:
            pass
    raise Broken(f"a turn of role {role!r} doesn't survive the round trip")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted: each turn rendered."""
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*source.schema.fields, T.StructField("formatted", T.StringType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                formatted = list(map(render, batch.column(2).to_pylist(), batch.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(formatted, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, start, loss_start, loss_end: the rendered text of each conversation, turn by turn in order, with the turn's place in it and its span of loss there, in code points (null without loss)."""
    rows = format_turns(turns).repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("start", "loss_start", "loss_end"))])

    def run(batches):
        conv = started = None
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = []
            for own, formatted in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not started or own != conv:
                    conv, started, reader = own, True, Reader()
                start = reader.at
                [(role, _, a, b)] = reader.feed(formatted)
                spans.append((start, a, b) if role == LOSS_ROLE else (start, None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*spans, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


class Digest:
    """What is read back from one conversation."""

    def __init__(self):
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss_start: int | None, loss_end: int | None) -> None:
        if loss_start is not None:
            said = unescape(formatted[loss_start - self.chars : loss_end - self.chars])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        for role, text, _, _ in self.reader.feed(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        self.reader.close()
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the rendered text and the loss spans of ``format_conversations``, whose order of rows it needs."""
    rows = formatted.select("conv_id", "formatted", "loss_start", "loss_end")
    kinds = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, k) for c, k in kinds.items())])

    def run(batches):
        done, conv, state = [], None, None

        def flush(kind):
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        done.append((conv, *state.row()))
                    conv, state = own, Digest()
                state.add(*row)
            if len(done) > 5000:
                yield flush(kind)
        if state is not None:
            done.append((conv, *state.row()))
            yield flush(kind)

    return rows.mapInArrow(run, schema)


#: The conversation that the query adds: control strings as plain text.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def report(turns: DataFrame) -> DataFrame:
    return read_back(format_conversations(with_probe(turns)))


#: The same rows by DuckDB; markers are counted, not rendered.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text)
    + len(regexp_extract_all(text, '\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|<\\*<SYS>>|<\\*</SYS>>|<\\*<ROLE>>|<\\*</ROLE>>|<\\*<:>>'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 22 + length(role) END AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
