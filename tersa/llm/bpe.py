"""Operator 1: byte-level BPE encoding and decoding.

Every distinct piece (match of the split pattern) of a block becomes a row of byte
tokens in a padded matrix; rows are bucketed by length. Each round, every row of a
matrix merges its leftmost pair of minimum rank: pairs are looked up in an
open-addressing hash table, the row closes up behind the merge, and rows without
a mergeable pair leave the matrix. Pieces of more than ``MATRIX_BYTES`` bytes are
matrices of one row, where a round performs, from the left, all merges of the minimum
rank up to the first that makes a pair of smaller rank: those that would follow each other
in rounds of one merge.

Defined cases: null text encodes as empty; empty text gives no ids; repeated rows
are encoded each; other columns pass through, but an input column that has the name of
an output (``ids``, ``decoded``) gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, ragged, ranges, texts

#: Pieces longer than this have a matrix of their own.
MATRIX_BYTES = 256
#: Elements of one matrix at most.
MATRIX_CELLS = 1 << 20
#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 250_000
NO_RANK = np.int32(np.iinfo(np.int32).max)
#: White space of the split pattern, spelled out so that no library's \s matters.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> id of the joined token, in an open-addressing hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NO_RANK, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, todo = self._slots(keys), np.arange(len(keys))
        self.probes = 1
        while len(todo):
            free = self.keys[slots[todo]] == -1
            _, first = np.unique(slots[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = joined[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, ``NO_RANK`` where a pair doesn't merge or a side is padding (< 0)."""
        out = np.full(left.shape, NO_RANK, dtype=np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.int64) << 32) | right[at].astype(np.int64)
        slots, found = self._slots(keys), np.full(len(keys), NO_RANK, dtype=np.int32)
        live = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[slots[live]]
            hit = held == keys[live]
            found[live[hit]] = self.values[slots[live[hit]]]
            live = live[~hit & (held != -1)]
            if not len(live):
                break
            slots[live] = (slots[live] + 1) & self.mask
        out[at] = found
        return out


class Codec:
    """Ranks of a vocabulary file, with what encoding and decoding need of them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_lengths = np.array([len(x) for x in tokens], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        parts = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(parts, dtype=np.int64).reshape(-1, 3).T)
        self.forget()

    def forget(self) -> None:
        """Start the memory of pieces afresh: piece -> number; ids of all numbers end to end."""
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def merge_matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of every row of byte tokens (padded with -1), in the order of the rows."""
        out: list = [None] * len(rows)
        names = np.arange(len(rows))
        width = rows.shape[1]
        pairs = self.pairs(rows[:, :-1], rows[:, 1:])
        while len(rows):
            at = pairs.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            best = pairs[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NO_RANK)
            done = best == NO_RANK
            if done.any():
                for name, row, n in zip(names[done], rows[done], (rows[done] >= 0).sum(axis=1), strict=True):
                    out[name] = row[:n]
                live = ~done
                rows, pairs, names, at, best = rows[live], pairs[live], names[live], at[live], best[live]
                if not len(rows):
                    break
            line, columns = np.arange(len(rows)), np.arange(width - 1)
            rows[line, at] = best
            rows[:, :-1] = np.take_along_axis(rows, columns + (columns > at[:, None]), axis=1)
            rows[:, -1] = -1
            if width > 2:
                pairs[:, :-1] = np.take_along_axis(pairs, columns[:-1] + (columns[:-1] > at[:, None]), axis=1)
            pairs[:, -1] = NO_RANK
            right = np.minimum(at + 1, width - 1)
            behind = np.minimum(at, width - 2)
            pairs[line, behind] = self.pairs(rows[line, behind], rows[line, np.minimum(behind + 1, width - 1)])
            pairs[line, behind] = np.where(right == at, NO_RANK, pairs[line, behind])
            left = np.nonzero(at > 0)[0]
            pairs[left, at[left] - 1] = self.pairs(rows[left, at[left] - 1], rows[left, at[left]])
            used = int((rows >= 0).sum(axis=1).max())
            if used < width // 2 + 1 and used > 1:
                width = used
                rows, pairs = np.ascontiguousarray(rows[:, :width]), np.ascontiguousarray(pairs[:, : width - 1])
        return out

    def merge_long(self, row: np.ndarray) -> np.ndarray:
        """Ids of one long row of byte tokens."""
        pairs = np.append(self.pairs(row[:-1], row[1:]), NO_RANK)
        while (best := pairs.min()) != NO_RANK:
            at = np.nonzero(pairs == best)[0]
            _, run = np.unique(np.cumsum(np.diff(at, prepend=-2) != 1), return_index=True)  # of neighbours, which share a token, the first, third, ... merge
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            around = np.concatenate([[-1], row, [-1]])
            before, after = around[at], np.append(around, -1)[at + 3]
            before[1:][at[1:] == at[:-1] + 2] = best
            joined = np.full(len(at), best, dtype=row.dtype)
            smaller = np.minimum(self.pairs(before, joined), self.pairs(joined, after)) < best
            at = at[: int(smaller.argmax()) + 1] if smaller.any() else at
            row[at] = best
            kept = np.ones(len(row), dtype=bool)
            kept[at + 1] = False
            row, pairs, at = row[kept], pairs[kept], at - np.arange(len(at))
            pairs[-1] = NO_RANK
            for near in (at[at < len(row) - 1], at[at > 0] - 1):
                pairs[near] = self.pairs(row[near], row[near + 1])
        return row

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        for i in np.nonzero(lengths > MATRIX_BYTES)[0]:
            out[i] = self.merge_long(self.byte_ids[np.frombuffer(pieces[i], dtype=np.uint8)])
        low = 0
        for width in (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, MATRIX_BYTES):
            names = np.nonzero((lengths > low) & (lengths <= width))[0]
            low = width
            step = max(1, MATRIX_CELLS // width)
            for names in (names[k : k + step] for k in range(0, len(names), step)):
                rows = np.full((len(names), width), -1, dtype=np.int32)
                n = lengths[names]
                flat = np.frombuffer(b"".join(pieces[i] for i in names), dtype=np.uint8)
                rows[np.repeat(np.arange(len(names)), n), ranges(np.zeros_like(n), n)] = self.byte_ids[flat]
                for i, ids in zip(names, self.merge_matrix(rows), strict=True):
                    out[i] = ids
        return out

    def learn(self, pieces: list[str]) -> None:
        ids = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        total, first = int(lengths.sum()), len(self.known)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(pieces) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + total] = np.concatenate(ids) if ids else 0
        self.lengths[first : first + len(pieces)] = lengths
        self.starts[first : first + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.used += total

    def numbers(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts end to end, and the count of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [self.pattern.findall(x) for x in block]
        new = set().union(*split) - self.known.keys()
        if new:
            self.learn(sorted(new))
        counts = np.array([len(x) for x in split], dtype=np.int64)
        number = self.known.__getitem__
        return np.fromiter((number(p) for x in split for p in x), dtype=np.int64, count=int(counts.sum())), counts

    def encode_block(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the count of each text."""
        numbers, counts = self.numbers(block)
        n = self.lengths[numbers]
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(counts)
        return self.ids[ranges(self.starts[numbers], n)], sums[ends] - sums[ends - counts]

    def count_block(self, block: list[str]) -> np.ndarray:
        """Tokens of each text."""
        numbers, counts = self.numbers(block)
        sums = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences end to end, and the byte count of each."""
        n = self.token_lengths[ids]
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(counts)
        return self.token_bytes[ranges(self.token_starts[ids], n)], sums[ends] - sums[ends - counts]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, pattern)


def binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` without its text column, with ``ids array<int>``; ``decoded``: also a binary column decoded back from them in the same pass."""
    kept = [c for c in docs.columns if c not in (text, ids, decoded)]
    schema = T.StructType([docs.schema[c] for c in kept]).add(ids, T.ArrayType(T.IntegerType()))
    schema = schema.add(decoded, T.BinaryType()) if decoded else schema

    def run(batches):
        own = codec(path, pattern)
        for block in blocks(batches, text):
            flat, counts = own.encode_block(texts(block, text))
            columns = [block.column(block.schema.get_field_index(c)) for c in kept] + [ragged(flat, counts, pa.int32())]
            if decoded:
                columns.append(binary(*own.decode_flat(flat, counts)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with its ids column replaced by the binary text they stand for (null ids: empty)."""
    kept = [c for c in rows.columns if c not in (ids, decoded)]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [binary(*own.decode_flat(flat, counts))], names=schema.names)

    return rows.select(*kept, ids).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    rows = encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
