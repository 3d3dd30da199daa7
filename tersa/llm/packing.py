"""Operator 6: packing by shortest-pack-first over the length histogram.

Documents are tokenized and cut into pieces of ``max_tokens`` and a rest. Only the
histogram of piece lengths (``max_tokens`` rows at most) reaches the driver. There,
lengths are placed longest first: all pieces of a length go, as counts, into the open
packing patterns with most room left, and what finds none opens new patterns. A
pattern is a multiset of lengths with the number of sequences that follow it, so the
plan's size depends on the histogram and not on the documents. Pieces then find their
sequence by rank: the k-th piece of a length takes the k-th place the plan has for it.
Ranks are built from counts by (length, salt), so that no length is numbered by one
task; the salt comes from a number that each piece gets when it is cut, so equal rows spread too.

Defined cases: null text is the single end token; repeated rows (and repeated or null
doc_id) are packed each; extra columns are dropped; an empty table packs nothing.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import blocks, materialize, ragged, ranges

MAX_TOKENS = 2048
END_ID = 1
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Pieces of one length and salt are numbered together; so many at about.
RANKED_TOGETHER = 100_000


class Memory:
    """Key -> number, and the values of all numbers end to end."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts, self.lengths = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def add(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, total = len(self.known), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = flat
        self.starts[first : first + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(keys)] = lengths
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.used += total


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of so many values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Tokens:
    """ids of whole texts, each distinct piece sent once through the tokenizers library.

    The vocabulary's pre-tokenizer drops white space, and no token, case mapping or
    normal form reaches across it, so a text's ids are those of its white-space
    separated words, and a word's those of its pieces. Both levels are dictionary
    encoded by Arrow, so that Python sees a block's distinct pieces only. What has a
    separator or a case that libraries class differently goes through the library whole.
    """

    ODD = [chr(c) for a, b in ((0x1C, 0x20), (0x1680, 0x1681), (0x180E, 0x180F), (0x2000, 0x2010), (0x2028, 0x2030), (0x205F, 0x2070), (0x3000, 0x3001), (0xFEFF, 0xFF00)) for c in range(a, b)]
    #: Beyond U+024F, and at the capital I with dot, case and class may differ between libraries.
    FOREIGN = "[^\\x{0}-\\x{12f}\\x{131}-\\x{24f}]"
    #: Fixed pattern of the vocabulary file's pre-tokenizer.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.pieces = Memory()
        self.pieces.add([""], np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))

    def whole(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all lines end to end, and the count of each; few encodings are held at a time."""
        flat, lengths = [np.zeros(0, dtype=np.uint32)], []
        for i in range(0, len(lines), 16):
            found = [x.ids for x in self.model.encode_batch_fast(lines[i : i + 16], add_special_tokens=False)]
            lengths += map(len, found)
            flat.append(np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32))
        return np.concatenate(flat), np.array(lengths, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Pieces are encoded in lines of many; each ends with the id of a word end."""
        flat, _ = self.whole([" ".join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)])
        lengths = np.diff(np.nonzero(self.ends[flat])[0], prepend=-1)
        if len(lengths) != len(pieces):
            raise ValueError("the vocabulary doesn't mark word ends")
        self.pieces.add(pieces, flat, lengths)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct words end to end, and the count of each."""
        foreign = np.asarray(pc.match_substring_regex(words, self.FOREIGN))
        plain = words.filter(pa.array(~foreign)) if foreign.any() else words
        spaced = pc.replace_substring_regex(pc.utf8_lower(plain), f"({self.PIECES})", r"\1 ")
        parts = pc.split_pattern(pc.utf8_rtrim(spaced, " "), " ")
        counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        distinct = parts.flatten().dictionary_encode()
        keys = distinct.dictionary.to_pylist()
        if len(self.pieces.known) > REMEMBERED:
            self.forget()
        new = [x for x in keys if x not in self.pieces.known]
        if new:
            self.learn(new)
        which = np.fromiter(map(self.pieces.known.__getitem__, keys), dtype=np.int64, count=len(keys))[np.asarray(distinct.indices)]
        lengths = self.pieces.lengths[which]
        flat, lengths = self.pieces.flat[ranges(self.pieces.starts[which], lengths)], sums(lengths, counts)
        if not foreign.any():
            return flat, lengths
        others, other_lengths = self.whole(words.filter(pa.array(foreign)).to_pylist())
        both = np.zeros(len(words), dtype=np.int64)
        both[~foreign], both[foreign] = lengths, other_lengths
        starts = np.zeros(len(words), dtype=np.int64)
        starts[~foreign], starts[foreign] = np.cumsum(lengths) - lengths, len(flat) + np.cumsum(other_lengths) - other_lengths
        return np.concatenate([flat, others])[ranges(starts, both)], both

    def encode_block(self, block: pa.Array) -> list[np.ndarray]:
        """ids of each text of an Arrow string column, null as empty."""
        block = pc.fill_null(block, "")
        split = pc.utf8_split_whitespace(block)
        counts = np.asarray(pc.list_value_length(split)).astype(np.int64)
        own = split.flatten().dictionary_encode()
        out = [np.zeros(0, dtype=np.uint32)] * len(block)
        if len(own):
            # an empty string (from white space at an end) has no ids
            flat, lengths = self.words(own.dictionary)
            which = np.asarray(own.indices).astype(np.int64)
            starts, lengths = (np.cumsum(lengths) - lengths)[which], lengths[which]
            out = np.split(flat[ranges(starts, lengths)], np.cumsum(sums(lengths, counts))[:-1])
        del own, split
        for i, text in enumerate(block.to_pylist()):
            if any(c in text for c in self.ODD):
                out[i] = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, serial (unique) and, if asked for, ids."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "serial"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        own, serial = tokens(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for block in blocks(batches, "text", 4 << 20):
            rows, which = [], []
            for i, ids in enumerate(own.encode_block(block.column(block.schema.get_field_index("text")))):
                ids = np.append(ids, np.uint32(END_ID))
                for start in range(0, len(ids), max_tokens):
                    part = ids[start : start + max_tokens].astype("<u4")
                    which.append(i)
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids), part))
            columns = [block.column(block.schema.get_field_index("doc_id")).take(pa.array(which))]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array(np.arange(serial, serial + len(rows)))]
            serial += len(rows)
            if with_ids:
                columns.append(ragged(np.concatenate([r[4] for r in rows]).astype(np.int32), np.array([r[1] for r in rows]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns, each (sequences, {length: times}): shortest pack first, longest lengths first."""
    open_: list[tuple[int, int]] = []  # heap of (filled, number): most room first
    packs: list[list] = []  # [filled, sequences, lengths]

    def add(filled: int, sequences: int, lengths: tuple[int, ...]) -> None:
        packs.append([sequences, lengths])
        if filled < max_tokens:
            heapq.heappush(open_, (filled, len(packs) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= max_tokens:
                filled, k = heapq.heappop(open_)
                sequences, lengths = packs[k]
                times = max(1, min((max_tokens - filled) // length, left // sequences)) if len(open_) < 1 else 1
                used = min(sequences, left // times)
                if used < sequences:  # the rest of this pattern's sequences stays as it was
                    packs[k][0] = sequences - used
                    heapq.heappush(open_, (filled, k))
                else:
                    packs[k] = None
                add(filled + times * length, used, lengths + (length,) * times)
                left -= used * times
            else:
                times = min(max_tokens // length, left)
                used = left // times
                add(times * length, used, (length,) * times)
                left -= used * times
    out = []
    for pack in packs:
        if pack:
            times: dict[int, int] = defaultdict(int)
            for length in pack[1]:
                times[length] += 1
            out.append((pack[0], dict(times)))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank first+i of a length lies in sequence first+i at offset."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for sequences, times in patterns:
        offset = 0
        for length in sorted(times, reverse=True):
            for _ in range(times[length]):
                rows.append((length, ranks[length], sequence, offset))
                ranks[length] += sequences
                offset += length
        sequence += sequences
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with rank, 0.. within each length."""
    salts = max(1, -(-rows // RANKED_TOGETHER)) * 8
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("serial"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "salt").orderBy("serial")
    return salted.withColumn("nth", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth")).drop("salt", "base", "nth", "serial")


def place(pieces: DataFrame, table: np.ndarray) -> DataFrame:
    """``pieces`` with rank replaced by sequence_id and offset."""
    spread = pieces.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in pieces.columns if c != "rank"]
    schema = T.StructType([pieces.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        rows = spread.value
        keys = (rows[:, 0] << 44) | rows[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank"))
                at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], names=schema.names)

    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    pieces = materialize(cut(docs, path, max_tokens, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = places(plan(histogram, max_tokens))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    if not len(table):
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).select(*names)
    return place(ranked(pieces, sum(histogram.values())), table).select(*names)
