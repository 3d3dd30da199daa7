"""Operator 2: SimHash near-dedup by tiled exact comparison.

A fingerprint is the majority bits over the XXH64 values of all word shingles: one
64-bit word, or more words for a finer estimate of similarity. Distinct fingerprints
are dealt into tiles by the population counts of parts of their first word: two
fingerprints at distance ``radius`` or less have counts whose differences sum to
``radius`` at most, so a tile is compared only with the tiles within that sum, by numpy
exclusive-or and bit counts, and every other tile pair is skipped unseen. Tiles of more
than ``tile`` fingerprints are split by hash and each part meets every part, in as many
tasks as its visitors need. A tile emits a spanning forest of its links instead of all pairs, and components follow from
alternating star contraction on those edges.

``Rule`` holds what links: by default the 3-word shingles, one word and two bits of the
query's contract. ``SIMILAR`` links by an estimate of similarity alone, from the 5-word
shingles. ``ALIKE`` is the rule of a filtering stage: texts whose sets of 5-word
shingles have a Jaccard index of 0.8 or more. 512 bits of the distinct shingles, with a
wide radius, only propose; the groups that follow from the proposals hold every link, and
in each of them the sets themselves are compared, by their 64-bit hashes. Since such sets
have sizes within the same ratio, tiles are also named by size class there, and only
neighbouring classes meet.

Keys that many rows share (copies of a text, hubs of the link graph) are joined by a
broadcast of bounded size, so no task gathers their rows.

Defined cases: null or wordless text has fingerprint zero and is linked like any
other; texts shorter than a shingle are a single shingle; a null doc_id takes part but
is never a component id (null if a component has no other); repeated rows share
their component; extra columns, whatever their names, pass through ``deduplicate`` unchanged
and through ``fingerprints`` unless named node, bits or weight; empty tables give empty tables.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, carried, carry, materialize, partitions, ranges, release, spread_join, texts

SEED = 42
#: Visitors that a tile's part meets in one task, in parts.
VISITORS = 4
#: Parts that all fingerprints would make at least, as long as a part has LEAST of them.
SPREAD, LEAST = 64, 2048
#: Elements of one exclusive-or matrix.
CELLS = 1 << 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """What is a shingle, how many words a fingerprint has, and what links."""

    shingle: int = 3
    words: int = 1
    #: Differing bits of the first word, at most.
    radius: int = 2
    #: Differing bits of all words, at most.
    limit: int = 2
    #: Equal parts of the first word whose population counts name a tile.
    parts: int = 4
    #: Neighbouring population counts that name one tile together.
    band: int = 1
    #: Distinct fingerprints of one tile's part at most, which are compared as one matrix side.
    tile: int = 8192
    #: Differing bits of the first two words, at most.
    second: int = 128
    #: Least Jaccard index, as numerator and denominator; the bits, of distinct shingles then, only propose.
    share: tuple[int, int] | None = None

    def __post_init__(self):
        if (self.share or self.band > 1) and self.parts != 1:
            raise ValueError("tiles by size class or by bands of counts take the first word whole")


#: Jaccard similarity 0.8 of shingle sets is a cosine of about 8/9, so an angle at which 0.15 of the
#: bits differ: 78 of 512 on average, with a standard deviation of 8, and 10 of 64, with one of 3.
SIMILAR = Rule(shingle=5, words=8, radius=16, limit=88, parts=1, tile=1 << 15)
#: Jaccard index 0.8 of shingle sets is a cosine of 8/9 or more, so an angle at which 0.15 of the bits differ
#: at most: 78 of 512 on average, with a standard deviation of 8, 19 of 128, with one of 4, and 10 of 64, with
#: one of 3. The bounds lie five deviations and more above these means.
ALIKE = Rule(shingle=5, words=8, radius=24, limit=136, parts=1, band=8, tile=1 << 15, second=44, share=(4, 5))
#: Bytes of text that one side of a comparison of sets holds at about (most, least), and what a text counts besides.
GROUP, LITTLE, EACH = 4 << 20, 1 << 18, 1000
#: Bits of the filter that finds proposed texts, at most.
FILTER = 1 << 27


def shingle_hashes(text: str, shingle: int):
    """The hashes of all shingles, uint64, in parts."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    digest, size = xxhash.xxh64_intdigest, min(shingle, len(words))
    for start in range(0, len(words) - size + 1, 1 << 13):
        part = words[start : start + (1 << 13) + size - 1]
        line = b" ".join(part)
        ends = list(itertools.accumulate(len(w) + 1 for w in part))
        begins = [0, *ends]
        yield np.array([digest(line[b : e - 1], SEED) for b, e in zip(begins, ends[size - 1 :], strict=False)], dtype="<u8")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes, in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingle_hashes(text, shingle)]))


def fingerprint(text: str, rule: Rule = Rule()) -> np.ndarray:
    """The words of bits, uint64."""
    return majority(in_parts(shingle_set(text, rule.shingle)) if rule.share else shingle_hashes(text, rule.shingle), rule)


def in_parts(hashes: np.ndarray):
    return (hashes[i : i + (1 << 13)] for i in range(0, len(hashes), 1 << 13))


def majority(parts, rule: Rule) -> np.ndarray:
    """The majority bits of hashes that come in parts."""
    ones, total = np.zeros(64 * rule.words, dtype=np.int64), 0
    for hashes in parts:
        total += len(hashes)
        every = np.stack([hashes, *(remixed(hashes, k) for k in range(1, rule.words))], axis=1)
        ones += np.unpackbits(every.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total, bitorder="little").view("<u8")


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Further bits of a 64-bit hash."""
    x = hashes * np.uint64(2 * k + 1) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """``docs`` without its text, with node (the first word, or a hash of several, or of the set if that decides), bits (all words) and weight (distinct shingles, if their set decides, else 0)."""
    kept = [c for c in docs.columns if c not in (text, "node", "bits", "weight")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("node", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("weight", T.LongType())])

    def run(batches):
        for block in blocks(batches, text):
            if rule.share:
                sets = [shingle_set(x, rule.shingle) for x in texts(block, text)]
                values = np.stack([majority(in_parts(x), rule) for x in sets])
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64)
                weights = [len(x) for x in sets]
            else:
                weights = [0] * block.num_rows
                values = np.stack([fingerprint(x, rule) for x in texts(block, text)])
                nodes = values[:, 0] if rule.words == 1 else np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in values], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index(c)) for c in kept] + [pa.array(nodes.view(np.int64)), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(weights, pa.int64())], names=schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def word_matrix(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, words)


def signature(first: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of equal parts of a word, seven bits each."""
    kind = {1: np.uint64, 2: np.uint32, 4: np.uint16}[parts]
    counts = np.bitwise_count(np.ascontiguousarray(first).view(kind).reshape(-1, parts)).astype(np.int64)
    return counts @ (128 ** np.arange(parts, dtype=np.int64))


@lru_cache(maxsize=4)
def class_bounds(share: tuple[int, int]) -> np.ndarray:
    """Least sizes of the size classes: sets whose sizes have a ratio of ``share`` or more lie in one class or in neighbours."""
    out = [0, 1]
    while out[-1] < 1 << 48:
        out.append(max(out[-1] + 1, -(-out[-1] * share[1] // share[0])))
    return np.array(out, dtype=np.int64)


def tiles_of(words: np.ndarray, weights: np.ndarray, rule: Rule) -> np.ndarray:
    """The tile of each fingerprint: its population counts and, if sets decide, its size class."""
    own = signature(words[:, 0], rule.parts) // rule.band
    return own + 128 * (np.searchsorted(class_bounds(rule.share), weights, side="right") - 1) if rule.share else own


def steps(rule: Rule) -> list[tuple[int, tuple[int, ...]]]:
    """Differences of the tiles that a tile visits, and of their population counts: each pair of tiles once."""
    zero, reach = (0,) * rule.parts, -(-rule.radius // rule.band)
    around = [d for d in itertools.product(range(-reach, reach + 1), repeat=rule.parts) if sum(map(abs, d)) <= reach]
    moves = [(sum(x * 128**k for k, x in enumerate(d)), d) for d in around]
    return [m for m in moves if m[1] > zero] + [(128 + move, d) for move, d in moves if rule.share]


def deal(fps: DataFrame, held: dict[int, int], rule: Rule) -> DataFrame:
    """(tile, part, visits, node, bits, weight): each fingerprint at home and in every tile that it visits. held: fingerprints by tile."""
    moves, most = steps(rule), 64 // rule.parts // rule.band
    names = sorted(held)
    tile = min(rule.tile, max(LEAST, sum(held.values()) // SPREAD))
    split = [-(-held[k] // tile) for k in names]
    # a part with many visitors is copied, and each copy meets a share of them
    visitors = [(0 if n == 1 else held[k]) + sum(held.get(k - move, 0) for move, _ in moves) for k, n in zip(names, split, strict=True)]
    copies = [max(1, -(-v // (VISITORS * tile))) for v in visitors]
    spread = fps.sparkSession.sparkContext.broadcast(tuple(map(np.array, (names, split, copies))))

    def run(batches):
        tiles, parts, times = spread.value
        for batch in batches:
            node = np.asarray(batch.column(0)).astype(np.int64)
            if not len(node):
                continue
            bits, weight = batch.column(1), batch.column(2)
            home = tiles_of(word_matrix(bits, rule.words), np.asarray(weight), rule)
            mine = ((node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
            at = np.searchsorted(tiles, home)
            split, own = parts[at], times[at]
            turn = ((node.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64)
            counts = np.stack([(home >> (7 * i)) & 127 for i in range(rule.parts)])
            every = np.arange(len(node))

            def rows(tile, part, visits, who):
                if len(who):
                    who_ = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(who), visits, dtype=np.int8)), batch.column(0).take(who_), bits.take(who_), weight.take(who_)], names=["tile", "part", "visits", "node", "bits", "weight"])

            for copy in range(int(own.max())):
                some = every[own > copy]
                yield from rows(home[some], (mine % split * own + copy)[some], 0, some)
            for k in range(1, int(split.max())):  # the parts of a tile visit its later parts
                some = every[(split > k) & (mine % split < k)]
                yield from rows(home[some], k * own[some] + turn[some] % own[some], 1, some)
            for move, deltas in moves:
                there = every[np.all([(c + d >= 0) & (c + d <= most) for c, d in zip(counts, deltas, strict=True)], axis=0)]
                goal = home[there] + move
                slot = np.minimum(np.searchsorted(tiles, goal), len(tiles) - 1)
                found = tiles[slot] == goal
                goal, slot, who = goal[found], slot[found], there[found]
                for k in range(int(parts[slot].max()) if len(slot) else 0):
                    some = parts[slot] > k
                    yield from rows(goal[some], (k * times[slot] + turn[who] % times[slot])[some], 1, who[some])

    return fps.select("node", "bits", "weight").mapInArrow(run, "tile int, part int, visits tinyint, node long, bits binary, weight long")


class Forest:
    """Union by smallest member over 0..n-1, whole arrays of links at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


def near(left: np.ndarray, right: np.ndarray, rule: Rule, sizes: tuple[np.ndarray, np.ndarray] | None = None):
    """Index pairs of rows of words that link, stripe by stripe. sizes: of the sets on both sides, if those decide."""
    step = max(1, CELLS // max(1, len(right)))
    first, others = np.ascontiguousarray(left[:, 0]), np.ascontiguousarray(right[:, 0])
    for start in range(0, len(left), step):
        a, b = np.nonzero(np.bitwise_count(first[start : start + step, None] ^ others[None, :]) <= rule.radius)
        if rule.share and sizes and len(a):
            x, y = sizes[0][a + start], sizes[1][b]
            fits = rule.share[1] * np.minimum(x, y) >= rule.share[0] * np.maximum(x, y)
            a, b = a[fits], b[fits]
        if rule.second < 128 and len(a):
            a, b = second(left, right, a, b, start, rule)
        if rule.words > 1 and len(a):
            close = np.concatenate([np.bitwise_count(left[a[i : i + (1 << 18)] + start] ^ right[b[i : i + (1 << 18)]]).sum(axis=1) <= rule.limit for i in range(0, len(a), 1 << 18)])
            a, b = a[close], b[close]
        if len(a):
            yield a + start, b


def second(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the first two words still propose."""
    bits = sum(np.bitwise_count(np.ascontiguousarray(left[start : start + int(a[-1]) + 1, k])[a] ^ np.ascontiguousarray(right[:, k])[b]) for k in range(2))
    return a[bits <= rule.second], b[bits <= rule.second]


def compare(dealt: DataFrame, rule: Rule) -> DataFrame:
    """Edges (u, v), u > v, that connect the same nodes as all links do."""
    n = partitions(dealt.sparkSession)
    sorted_ = dealt.repartition(n, "tile", "part").sortWithinPartitions("tile", "part", "visits")

    def runs(batches):
        """(key, visits, nodes, words, weights) for each run of rows with the same tile, part and visits."""
        for batch in batches:
            tile, part, visits, node, weight = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 2, 3, 5))
            key = (tile << 32) | (part << 1) | visits
            cuts = [0, *(np.nonzero(np.diff(key))[0] + 1).tolist(), len(key)]
            words = word_matrix(batch.column(4), rule.words)
            for a, b in itertools.pairwise(cuts):
                if b > a:
                    yield int(key[a]) >> 1, int(visits[a]), node[a:b], words[a:b], weight[a:b]

    def links(batches):
        for _, own in itertools.groupby(runs(batches), key=itemgetter(0)):
            home, forest = [], None
            for _, visits, nodes, words, weights in own:  # a tile's own fingerprints come first
                if not visits:
                    home.append((nodes, words, weights))
                    continue
                if not home:
                    break
                if forest is None:
                    home = [tuple(map(np.concatenate, zip(*home, strict=True)))]
                    forest = tile_links(*home[0][1:], rule)
                for a, b in near(home[0][1], words, rule, (home[0][2], weights)):  # one edge for each guest and component that it links to
                    pairs = np.unique(forest.up[a] * len(words) + b)
                    yield home[0][0][pairs // len(words)], nodes[pairs % len(words)]
            if home:
                home = [tuple(map(np.concatenate, zip(*home, strict=True)))]
                forest = forest or tile_links(*home[0][1:], rule)
                inner = np.nonzero(forest.up != np.arange(len(forest.up)))[0]
                yield home[0][0][inner], home[0][0][forest.up[inner]]

    def run(batches):
        us, vs, n = [], [], 0
        for u, v in itertools.chain(links(batches), [(None, None)]):
            if u is not None:
                us.append(u)
                vs.append(v)
                n += len(u)
            if us and (u is None or n >= 50_000):
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])
                us, vs, n = [], [], 0

    return sorted_.mapInArrow(run, "u long, v long")


def tile_links(words: np.ndarray, weights: np.ndarray, rule: Rule) -> Forest:
    """The components of one tile by its own links."""
    forest = Forest(len(words))
    for a, b in near(words, words, rule, (weights, weights)):
        forest.join(a, b)
    return forest


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root the smallest node reachable: alternating large-star and small-star rounds until nothing changes."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(state).first()[0]
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = materialize(spread_join(both, least, "u", "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        joined = spread_join(large, small, "u", "n", before[0])
        next_ = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        next_ = materialize(next_, "edges")
        for done in (now, least, large, small):
            release(done)
        now, after = next_, next_.agg(state).first()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(rows: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of every node that links to another. rows: node, bits and weight, repeated as they come."""
    fps = materialize(rows.groupBy("node").agg(F.min("bits").alias("bits"), F.min("weight").alias("weight")), "distinct")

    def tiles(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tiles_of(word_matrix(batch.column(0), rule.words), np.asarray(batch.column(1)), rule).astype(np.int32))], names=["tile"])

    # as many as there are tiles: 17 ** 4 at most, or 65 in each of some 150 size classes
    cells = fps.select("bits", "weight").mapInArrow(tiles, "tile int").groupBy("tile").count()
    held = {r["tile"]: r["count"] for r in cells.collect()}
    links = materialize(components(compare(deal(fps, held, rule), rule) if held else fps.select(F.col("node").alias("u"), F.col("node").alias("v"))), "links")
    release(fps)
    return links


def set_links(sets: list[np.ndarray], share: tuple[int, int]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs whose Jaccard index is ``share`` or more; two empty sets are alike."""
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    ends, owner, open_ = np.cumsum(sizes), np.repeat(np.arange(n), sizes), np.ones(n, dtype=bool)
    by = np.argsort(shingle, kind="stable")
    holders, first = owner[by], np.searchsorted(shingle[by], np.arange(len(shingle) + 1))
    up, down, left, indexed = [], [], n, n
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed], left, queue = False, left - 1, [seed]
        while queue and left:
            if 2 * left < indexed:  # those that are placed need no more counting
                by, indexed = by[open_[owner[by]]], left
                holders, first = owner[by], np.searchsorted(shingle[by], np.arange(len(shingle) + 1))
            i = queue.pop()
            own = shingle[ends[i] - sizes[i] : ends[i]]
            shared = np.bincount(holders[ranges(first[own], first[own + 1] - first[own])], minlength=n)
            found = np.nonzero(open_ & (share[1] * shared >= share[0] * (sizes + sizes[i] - shared)))[0].tolist()
            open_[found] = False
            left -= len(found)
            up += [i] * len(found)
            down += found
            queue += found
    return up, down


def filtered(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with asked: whether their key may be one of ``members``, by a broadcast bitmap of FILTER bits at most (never false for a member)."""
    bits = min(FILTER, 1 << max(15, (16 * members.count()).bit_length()))
    place = F.pmod(F.col("key"), F.lit(bits))
    slots = members.groupBy(F.floor(place / 32768).alias("slot")).agg(F.bitmap_construct_agg(place % 32768).alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", ((place % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("slot", F.floor(place / 32768)).join(F.broadcast(slots), "slot", "left").withColumn("asked", asked).drop("slot", "bitmap")


def verified(docs: DataFrame, firsts: DataFrame, proposed: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of every node that links to another by its set. firsts: node and a text of it (doc_id, key, size); proposed: (node, root) of groups that hold all links; docs with their key.

    A group's texts are dealt into parts of bounded size and each part meets every part.
    """
    members = materialize(firsts.join(proposed, "node"), "members")
    # texts that no link is proposed for are left where they are
    asked = filtered(docs.select("doc_id", "key", "text"), members).where("asked").drop("asked")
    whole = members.agg(F.sum(F.col("size") + EACH)).first()[0] or 0
    side = min(GROUP, max(LITTLE, whole // (2 * partitions(docs.sparkSession))))
    times = members.groupBy("root").agg(F.ceil(F.sum(F.col("size") + EACH) / side).cast("int").alias("times"))
    dealt = members.join(times, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("times")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    met = asked.join(dealt, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("root", "a", "b", "node", "text")
    met = met.repartition(partitions(docs.sparkSession), "root", "a", "b").sortWithinPartitions("root", "a", "b", "node")

    def rows(batches):
        for block in blocks(batches, "text"):
            yield from zip(zip(*(block.column(k).to_pylist() for k in range(3)), strict=True), block.column(3).to_pylist(), texts(block), strict=True)

    def run(batches):
        for _, own in itertools.groupby(rows(batches), key=itemgetter(0)):
            nodes, sets = [], []
            for _, node, text in own:
                if not nodes or nodes[-1] != node:  # repeated rows
                    nodes.append(node)
                    sets.append(shingle_set(text, rule.shingle))
            up, down = set_links(sets, rule.share)
            if up:
                nodes = np.array(nodes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[up]), pa.array(nodes[down])], names=["u", "v"])

    links = materialize(components(met.mapInArrow(run, "u long, v long")), "links")
    release(members)
    return links


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits; for several words, of their hash) and component_id of every row of ``docs``."""
    rows = materialize(fingerprints(docs.select("doc_id", "text"), rule), "fingerprints")
    links = linked(rows, rule)
    firsts = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "firsts")
    of_root = links.join(firsts, "node").groupBy("root").agg(F.min("first_id").alias("least_id"))
    of_node = links.join(of_root, "root").select("node", "least_id")
    named = materialize(firsts.join(of_node, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("component_id"), "n"), "components")
    for done in (links, firsts):
        release(done)
    whole = spread_join(rows.drop("bits", "weight"), named, "node", "n", rows.count())
    return whole.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, rule: Rule = ALIKE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then smallest text hash (null ids last).

    Rows that no other repeats and none links to stay where they are; only the others move.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", "text", F.xxhash64(whole).alias("key"), F.octet_length(whole).cast("long").alias("size"))
    rows = materialize(fingerprints(own, rule), "fingerprints")
    links = linked(rows, rule)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("size").alias("size"))
    total = rows.count()
    copies = materialize(rows.groupBy("node", "key").agg(F.min(order).alias("first"), F.count("*").alias("n")), "copies")
    nodes = copies.groupBy("node").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    if rule.share:
        proposed, links = links, verified(own, nodes.select("node", "first.doc_id", "first.key", "first.size"), links, rule)
        release(proposed)
    # a node is contested if it has several rows or links to another
    contested = materialize(nodes.join(links, "node", "left").where("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "first", "texts"), "contested")
    texts_ = spread_join(copies.select("node", "key", F.col("n").alias("rows")), contested.select("node", "texts"), "node", "texts", copies.count())
    asked = texts_.groupBy("key").agg(F.sum("rows").alias("n"))
    # the one row that stays of a group has one text; of the group's other texts none stays
    chosen = contested.groupBy("root").agg(F.min("first").alias("first")).select("first.key", F.col("first.doc_id").alias("stays"), F.lit(True).alias("chosen")).dropDuplicates(["key"])
    verdicts = materialize(asked.join(chosen, "key", "left").withColumn("known", F.lit(True)), "verdicts")
    marked = filtered(carry(docs, doc_id=F.col("doc_id"), key=F.xxhash64(whole)), verdicts)
    judged = spread_join(marked.where("asked").drop("asked"), verdicts, "key", "n", total, "left")
    stay = judged.where(F.col("known").isNull() | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("stays")))).dropDuplicates(["doc_id", "key"])
    for done in (rows, copies, contested):
        release(done)
    return marked.where("not asked").select(*carried(docs.columns)).unionByName(stay.select(*carried(docs.columns)))
