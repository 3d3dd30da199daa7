"""Operator 3: approximate nearest neighbours by robust-pruned directed graphs.

Equal vectors are one point, which keeps its smallest vec_ids (as many as a result can
hold and one more, since a query is no answer to itself), so a hot vector neither fills
beams nor tasks. Points are dealt into shards by hash. In each shard a directed graph is
grown batch by batch: a greedy beam search from the shard's medoid proposes neighbours
for every new vector, relaxed distance pruning (an edge is dropped if a kept one is
``RELAX`` times closer to its end) keeps diverse edges, and back edges are added and
pruned the same way. Queries travel in blocks of bounded size: every block is sent to
every group of shards, where it is beam-searched in each graph. The proposals are scored
by exact cosine in double precision and merged over shards. Nothing but the most common
length reaches the driver, and nothing is broadcast.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part; repeated rows of one vec_id count once
(the least vector, if they differ); null vec_id takes no part; equal scores go to the
smaller vec_id; components of any finite size are scaled by powers of two before they
are multiplied, which changes no other score; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize, partitions, ranges, release

#: Points of one shard, at about.
SHARD = 4096
DEGREE = 32
BUILD_BEAM, SEARCH_BEAM = 64, 128
#: Beam entries that are expanded together.
STRIDE = 4
RELAX = 1.2
#: Queries of one block at most.
QUERY_BLOCK = 1024
#: Shards that one task holds at most, and queries that it takes through them, at about.
TOGETHER, QUERIES = 8, 1 << 16
#: Vectors that join a graph together at most.
BATCH = 256


def beam_search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nearest points found and their squared distances, nearest first. graph: neighbours, -1 for none."""
    n, q = len(points), len(queries)
    ids = np.full((q, beam), -1, dtype=np.int64)
    far = np.full((q, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n + 1), dtype=bool)
    ids[:, 0], far[:, 0], open_[:, 0] = start, ((queries - points[start]) ** 2).sum(axis=1), True
    seen[:, start] = seen[:, n] = True
    live = np.arange(q)
    while len(live):
        ranked = np.argsort(~open_[live], axis=1, kind="stable")[:, :STRIDE]
        picked = np.take_along_axis(open_[live], ranked, axis=1)
        nodes = np.where(picked, np.take_along_axis(ids[live], ranked, axis=1), -1)
        open_[live[:, None], ranked] = False
        around = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        around = np.where(around < 0, n, around)
        around.sort(axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = n
        around[seen[live[:, None], around]] = n
        seen[live[:, None], around] = True
        width = int((around < n).sum(axis=1).max(initial=0))
        if width:
            around = np.sort(around, axis=1)[:, :width]
            there = around < n
            near = np.full(around.shape, np.inf, dtype=np.float32)
            row, column = np.nonzero(there)
            gap = points[around[row, column]] - queries[live[row]]
            near[row, column] = np.einsum("ij,ij->i", gap, gap)
            all_far = np.concatenate([far[live], near], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, best, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(there, around, -1)], axis=1), best, axis=1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], there], axis=1), best, axis=1)
        live = live[open_[live].any(axis=1)]
    return ids, far


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE of each row's candidates (-1: none), nearest first, without those that a kept one covers."""
    rows, width = candidates.shape
    ordered = np.sort(candidates, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    ordered[ordered == own[:, None]] = -1
    vectors = points[ordered]
    gap = vectors - points[own][:, None, :]
    far = np.where(ordered >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    norms = np.einsum("ijk,ijk->ij", vectors, vectors)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out, line = np.full((rows, DEGREE), -1, dtype=np.int64), np.arange(rows)
    for k in range(DEGREE):
        best = far.argmin(axis=1)
        found = np.isfinite(far[line, best])
        if not found.any():
            break
        out[found, k] = ordered[line, best][found]
        covered = RELAX * between[line, best] <= far
        far[covered & found[:, None]] = np.inf
        far[line, best] = np.inf
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, int]:
    """The graph over unit vectors, and where searches start."""
    n = len(points)
    center = points.mean(axis=0)
    start = int(((points - center) ** 2).sum(axis=1).argmin())
    graph = np.full((n + 1, DEGREE), -1, dtype=np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        new = order[done : done + max(1, min(BATCH, done // 2 + 1))]
        found, _ = beam_search(points, graph, points[new], BUILD_BEAM, start)
        graph[new] = prune(points, new, found)
        source = np.repeat(new, DEGREE)
        target = graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.lexsort((source, target))
        source, target = source[by], target[by]
        hit, first, counts = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, counts)
        # most get few back edges at once; the others are pruned in turns
        for turn in range(0, int(counts.max(initial=0)), DEGREE):
            some = (nth >= turn) & (nth < turn + DEGREE)
            who, index = np.unique(target[some], return_inverse=True)
            more = np.full((len(who), DEGREE), -1, dtype=np.int64)
            more[index, nth[some] - turn] = source[some]
            both = np.concatenate([graph[who], more], axis=1)
            full = (both >= 0).sum(axis=1) > DEGREE
            packed = -np.sort(-both, axis=1)[:, :DEGREE]
            graph[who[~full]] = packed[~full]
            if full.any():
                graph[who[full]] = prune(points, who[full], both[full])
        done += len(new)
    return graph, start


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of what takes part."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """v and ids (the ``k + 1`` smallest vec_ids that have it, ascending). A hot vector's rows are cut down before they are shuffled."""
    nth = F.row_number().over(W.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 1/2 or more and under 1."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).astype(np.float32)


#: kind 0: a shard (ids of all points end to end, how many each has, vectors, graph); kind 1: a block of queries (ids, vectors).
PARCEL = "kind int, number long, width int, start int, ids binary, counts binary, vectors binary, graph binary"
_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = [c.split()[0] for c in PARCEL.split(", ")]


def parcel(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _KINDS, strict=True)], names=_NAMES)


def index(points: DataFrame, shards: int) -> DataFrame:
    """A parcel per shard: its ids, vectors (double) and graph."""
    n = min(shards, partitions(points.sparkSession) * 4)
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard").select("shard", "v", "ids")

    def close(shard, parts):
        vectors, ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort(vectors.T[::-1])  # whatever order the rows came in
        firsts = np.cumsum(counts) - counts
        ids = np.concatenate([ids[firsts[i] : firsts[i] + counts[i]] for i in order])
        vectors, counts = vectors[order], counts[order]
        graph, start = build(unit(vectors))
        return parcel(0, shard, vectors.shape[1], start, ids.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), vectors.astype("<f8").tobytes(), graph.astype("<i4").tobytes())

    def run(batches):
        now, parts = None, []
        for batch in batches:
            shard = np.asarray(batch.column(0))
            cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(shard)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if parts and int(shard[a]) != now:
                    yield close(now, parts)
                    parts = []
                now = int(shard[a])
                lists = batch.column(2).slice(a, b - a)
                parts.append((matrix(batch.column(1).slice(a, b - a)), np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)))
        if parts:
            yield close(now, parts)

    return dealt.mapInArrow(run, PARCEL)


def query_blocks(asked: DataFrame) -> DataFrame:
    """Parcels of QUERY_BLOCK queries at most."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                ids, vectors = np.asarray(batch.column(0).slice(a, QUERY_BLOCK)), matrix(batch.column(1).slice(a, QUERY_BLOCK))
                yield parcel(1, int(ids[0]), vectors.shape[1], 0, ids.astype("<i8").tobytes(), b"", vectors.astype("<f8").tobytes(), b"")

    return asked.select("vec_id", "v").mapInArrow(run, PARCEL)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of scaled vectors."""
    return (vectors * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(axis=1)))


class Shard:
    def __init__(self, row: dict):
        self.ids, self.start = np.frombuffer(row["ids"], dtype="<i8"), row["start"]
        self.counts = np.frombuffer(row["counts"], dtype="<i4").astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.vectors = scaled(np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, row["width"]))
        self.points = unit(self.vectors)
        self.graph = np.frombuffer(row["graph"], dtype="<i4").reshape(-1, DEGREE).astype(np.int64)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """(query ids, vec_ids, scores): the best k of this shard for each query."""
        near, queries = unit(queries), scaled(queries)
        for a in range(0, len(ids), BATCH):
            found, _ = beam_search(self.points, self.graph, near[a : a + BATCH], SEARCH_BEAM, self.start)
            for q, row in zip(range(a, a + len(found)), found, strict=True):
                row = row[row >= 0]
                n = self.counts[row]
                own = self.ids[ranges(self.firsts[row], n)]
                scores = np.repeat(cosines(queries[q], self.vectors[row]), n)
                own, scores = own[own != ids[q]], scores[own != ids[q]]
                best = np.lexsort((own, -scores))[:k]
                yield np.full(len(best), ids[q]), own[best], scores[best]


def search(shards: DataFrame, blocks: DataFrame, groups: int, shares: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each shard for each query. Every block visits every group of shards; a group is copied ``shares`` times, and each copy takes a share of the blocks."""
    n = partitions(shards.sparkSession)
    home = shards.withColumn("group", F.pmod("number", F.lit(groups))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    guests = blocks.withColumn("share", F.pmod(F.xxhash64("number"), F.lit(shares)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    both = home.unionByName(guests).select("group", "share", *_NAMES)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key, row = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), {c: batch.column(2 + j)[i].as_py() for j, c in enumerate(_NAMES)}
                if key != now:
                    now, held = key, []
                if row["kind"] == 0:  # a group's shards come first
                    held.append(Shard(row))
                    continue
                ids, queries = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, row["width"])
                out = [x for shard in held for x in shard.search(ids, queries, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return both.repartition(min(n * 4, groups * shares), "group", "share").sortWithinPartitions("group", "share", "kind", "number").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queried, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for every row that ``queried`` (a condition on vec_id) holds for."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count(F.when(queried, True)).alias("asked")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths or not widths[0]["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == widths[0]["width"])
    points = materialize(points_of(rows, k), "points")
    n = max(1, round(points.count() / SHARD))
    shards = materialize(index(points, n), "shards")
    release(points)
    groups = max(1, min(n, max(4 * partitions(spark), -(-n // TOGETHER))))
    found = search(shards, query_blocks(rows.where(queried)), groups, max(1, -(-widths[0]["asked"] // QUERIES)), k)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 50 == 0)
