"""Operator 10: stupid-backoff scores from hash-partitioned n-gram tables.

Texts become word numbers, a row per block of documents, in a table bucketed by block.
Every block explodes into its distinct n-grams, keyed by 64-bit hashes and counted
within the block; the sorted keys go to ranges of the hash space. A range adds up the
counts of its share of the corpus' n-gram table and joins them back to the keys that
each block sent, and the answers return to the blocks. First go the words and pairs;
a longer n-gram can only occur twice if both n-grams of one word less in it do, so each
further round sends only those, and all others occur exactly once, here. Then each
word's score is the relative frequency of the longest n-gram that the rest of the corpus
holds, discounted by ``ALPHA`` for each order given up, and a document's score is the sum
of its words' logarithms. The rest of the corpus is all documents but the one that is scored:
its own n-grams are taken off the counts, since a text is no evidence for itself (``lm_scores``
can also leave them in). A frequent n-gram reaches its range once per block, not once per
occurrence, so no key is hot; texts stay where their bucket is.

Defined cases: null and wordless texts score 0 over 0 words (score null); n-grams don't cross
documents; a word that no other document holds counts as one occurrence; repeated rows are
documents each, so they are evidence for each other; extra columns are ignored; an empty
table gives no rows. Two different n-grams with the same 64-bit hash would share a count.
"""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import blocks, delete, materialize, partitions, release, shared_folder, texts, trim

ORDER = 3
ALPHA = 0.4
#: Bytes of text in a block.
BLOCK = 6 << 20
#: n-gram occurrences of one range of the hash space, at about.
RANGE = 1_500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def number_words(block: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers end to end, and the words of each text."""
    split = [x.encode("utf-8", "surrogatepass").translate(_LOWER).split() for x in block]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    names: dict[bytes, int] = {}
    numbers = np.fromiter((names.setdefault(w, len(names)) for x in split for w in x), dtype=np.uint32, count=int(counts.sum()))
    return list(names), numbers, counts


def longer(shorter: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The keys of n-grams of one word more: at each word, the n-gram that ends before it and the word."""
    out = shorter.copy()
    out[1:] = mixed(shorter[:-1] * _MIX + own[1:])
    return out


def depth(counts: np.ndarray) -> np.ndarray:
    """Words before each word in its text."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def packed(values: np.ndarray) -> bytes:
    """Sorted keys as differences, high bytes apart from low ones, so that the zero bytes compress."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = 8 if not len(steps) else max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(steps) > 1 else 8
    return bytes([width]) + (values[:1].astype("<u8").tobytes() if len(values) else b"") + np.ascontiguousarray(planes[:width, 1:]).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = data[0]
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(data[1:9], dtype=np.uint8)
    steps[1:, :width] = np.frombuffer(data[9:], dtype=np.uint8).reshape(width, n - 1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def counts_packed(values: np.ndarray) -> bytes:
    """As many byte planes as the largest value needs, after their number."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def counts_unpacked(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=max(1, width * n)), dtype=np.uint8)
    values = np.zeros((n, 8), dtype=np.uint8)
    values[:, :width] = planes.reshape(width, n).T
    return values.view("<u8").ravel()


def in_ranges(keys: np.ndarray, ranges: int):
    """(range, start, end) of the slices of sorted keys."""
    which = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.nonzero(np.diff(which))[0] + 1).tolist(), len(keys)]
    return [(int(which[a]), a, b) for a, b in itertools.pairwise(cuts) if b > a]


TEXTS = "block long, n long, numbers binary, words binary, counts binary, ids array<long>"


def number_texts(docs: DataFrame) -> DataFrame:
    """A row per block: its words as numbers, the distinct words' keys, the words of each document, and doc_id."""

    def run(batches):
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        for nth, block in enumerate(blocks(batches, "text", BLOCK)):
            words, numbers, counts = number_words(texts(block))
            ids = block.column(block.schema.get_field_index("doc_id")).cast(pa.int64())
            columns = ([task | nth], [len(numbers)], [counts_packed(numbers)], [word_keys(words).astype("<u8").tobytes()], [counts.astype("<u8").tobytes()], [ids.to_pylist()])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "n", "numbers", "words", "counts", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, TEXTS)


def by_block(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of this name in the shared folder, bucketed by block, so that joining answers to it moves no text."""
    spark = rows.sparkSession
    rows.write.format("parquet").option("path", f"{shared_folder(spark)}/{name}").bucketBy(partitions(spark), "block").saveAsTable(name)
    return spark.table(name)


KEYS = "part int, block long, n long, keys binary, counts binary"


def keys_batch(block: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    rows = [(part, block, b - a, packed(keys[a:b]), counts_packed(counts[a:b])) for part, a, b in in_ranges(keys, ranges)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "block", "n", "keys", "counts"])


class Block:
    """A block's words and, order by order, the keys and corpus counts of the n-grams that end at each word."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.counts = np.frombuffer(row["counts"], dtype="<u8").astype(np.int64)
        self.own = np.frombuffer(row["words"], dtype="<u8")[counts_unpacked(row["numbers"], row["n"])] if row["n"] else np.zeros(0, dtype=np.uint64)
        self.depth = depth(self.counts)
        pairs = longer(self.own, self.own)
        self.keys = [self.own, pairs]
        self.inside = self.depth >= 1

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all words and pairs."""
        return np.concatenate([self.own, self.keys[1][self.inside]]), np.nonzero(self.inside)[0]

    def learn(self, answers: list[dict]) -> list[np.ndarray]:
        """Corpus counts of each order at each word, as far as the answers go. answers: by round and part."""
        rounds: dict[int, list] = {}
        for a in sorted(answers, key=lambda a: (a["round"], a["part"])):
            rounds.setdefault(a["round"], []).append(counts_unpacked(a["counts"], a["n"]))
        every, pairs = self.first()
        _, place = np.unique(every, return_inverse=True)
        found = np.concatenate(rounds[0]).astype(np.int64)[place] if rounds else np.zeros(len(every), dtype=np.int64)
        seen = [found[: len(self.own)], np.zeros(len(self.own), dtype=np.int64)]
        seen[1][pairs] = found[len(self.own) :]
        for order in range(3, ORDER + 1):
            keys, some = self.candidates(seen, order)
            counts = (self.depth >= order - 1).astype(np.int64)
            if order - 2 in rounds:
                _, place = np.unique(keys, return_inverse=True)
                counts[some] = np.concatenate(rounds[order - 2]).astype(np.int64)[place]
            elif len(keys):
                break
            seen.append(counts)
        return seen

    def inside_own(self, order: int) -> np.ndarray:
        """At each word, how often its own document holds the n-gram that ends there (0 if none does)."""
        where = self.depth >= order - 1
        own = np.zeros(len(where), dtype=np.int64)
        documents = np.repeat(np.arange(len(self.counts), dtype=np.uint64), self.counts)
        _, place, counts = np.unique(mixed(self.keys[order - 1][where] + documents[where] * _MIX), return_inverse=True, return_counts=True)
        own[where] = counts[place]
        return own

    def candidates(self, seen: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and places of the n-grams of ``order`` words in which both shorter ones occur twice or more; those of the other places occur once."""
        if len(self.keys) < order:
            self.keys.append(longer(self.keys[-1], self.own))
        repeated = seen[order - 2] >= 2
        both = repeated.copy()
        both[1:] &= repeated[:-1]
        some = np.nonzero(both & (self.depth >= order - 1))[0]
        return self.keys[order - 1][some], some


def rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
    trim()


def explode(stored: DataFrame, ranges: int) -> DataFrame:
    """The distinct words and pairs of every block, by range."""

    def run(batches):
        for row in rows_of(batches):
            if row["n"]:
                yield keys_batch(row["block"], *np.unique(Block(row).first()[0], return_counts=True), ranges)

    return stored.mapInArrow(run, KEYS)


def explode_longer(stored: DataFrame, answered: DataFrame, order: int, ranges: int) -> DataFrame:
    """The distinct n-grams of ``order`` words that can have been seen more than once, by range."""

    def run(batches):
        for row in rows_of(batches):
            block = Block(row)
            keys, _ = block.candidates(block.learn(row["answers"]), order)
            if len(keys):
                yield keys_batch(row["block"], *np.unique(keys, return_counts=True), ranges)

    return stored.join(answered, "block").mapInArrow(run, KEYS)


def count(exploded: DataFrame) -> DataFrame:
    """part, block, n, counts: the corpus counts of the keys that each block sent."""
    n = partitions(exploded.sparkSession)

    def run(batches):
        for part, own in itertools.groupby(rows_of(batches), key=lambda r: r["part"]):
            asked, keys, seen = [], [], []
            for row in own:
                asked.append((row["block"], row["n"]))
                keys.append(unpacked(row["keys"], row["n"]))
                seen.append(counts_unpacked(row["counts"], row["n"]))
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            total = np.bincount(place, weights=np.concatenate(seen), minlength=len(every)).astype(np.int64)
            answers = np.split(total[place], np.cumsum([k for _, k in asked])[:-1])
            columns = ([part] * len(asked), [b for b, _ in asked], [k for _, k in asked], [counts_packed(a) for a in answers])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "n", "counts"])

    return exploded.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(run, "part int, block long, n long, counts binary")


def gathered(rounds: list[DataFrame]) -> DataFrame:
    """block, answers: the answers of all rounds to each block."""
    every = reduce(DataFrame.unionByName, (r.withColumn("round", F.lit(k)) for k, r in enumerate(rounds)))
    return every.groupBy("block").agg(F.collect_list(F.struct("round", "part", "n", "counts")).alias("answers"))


def word_scores(seen: list[np.ndarray], inside: np.ndarray, total: np.ndarray, least: int) -> np.ndarray:
    """Logarithm of each word's score. seen: counts by order; inside: words before it in its text; total: words of the corpus; least: the count that is believed."""
    score = np.log(np.maximum(seen[0], 1) / np.maximum(total, 1))
    for k in range(1, ORDER):
        before = np.concatenate([[1], seen[k - 1][:-1]])
        fits = inside >= k
        found = fits & (seen[k] >= least)
        score = np.where(found, np.log(np.maximum(seen[k], 1) / np.maximum(before, 1)), score + np.log(ALPHA) * fits)
    return score


def score(stored: DataFrame, answered: DataFrame, total: int, least: int, own: bool) -> DataFrame:
    """doc_id, n_words, log_score of every document."""

    def run(batches):
        for row in rows_of(batches):
            block = Block(row)
            sums, some = np.zeros(len(block.counts)), block.counts > 0
            if some.any():
                seen, words = block.learn(row["answers"] or []), np.full(len(block.own), total)
                if not own:
                    seen = [every - block.inside_own(k + 1) for k, every in enumerate(seen)]
                    words -= np.repeat(block.counts, block.counts)
                sums[some] = np.add.reduceat(word_scores(seen, block.depth, words, least), (np.cumsum(block.counts) - block.counts)[some])
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.counts), pa.array(sums)], names=["doc_id", "n_words", "log_score"])

    return stored.join(answered, "block", "left").mapInArrow(run, "doc_id long, n_words long, log_score double")


def lm_scores(docs: DataFrame, ranges: int | None = None, seen: int = 1, own: bool = False) -> DataFrame:
    """doc_id, n_words, log_score and score (mean per word) of every document. seen: occurrences from which an n-gram is believed; own: whether a document's own occurrences count."""
    spark, name = docs.sparkSession, f"tersa_blocks_{uuid.uuid4().hex}"
    stored = by_block(number_texts(docs), name)
    total = stored.agg(F.sum("n")).first()[0] or 0
    ranges = ranges or max(partitions(spark), -(-total * ORDER // RANGE))
    rounds = [materialize(count(explode(stored, ranges)), "counts")]
    for order in range(3, ORDER + 1):
        rounds.append(materialize(count(explode_longer(stored, gathered(rounds), order, ranges)), "counts"))
    scored = materialize(score(stored, gathered(rounds), total, seen, own), "scores")
    for done in rounds:
        release(done)
    spark.sql(f"DROP TABLE {name}")
    delete(spark, f"{shared_folder(spark)}/{name}")
    return scored.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
