"""Approximate nearest neighbours over balanced posting lists.

A bounded sample of the vectors is split in two again and again until every part stands for about
`list_rows` vectors: the centroids. Every vector is posted to its nearest centroid, and boundary
vectors also to others that are nearly as near, unless a chosen centroid is nearer to that centroid
than the vector is. A query finds its nearest centroids by a best-first walk over an in-memory
graph of centroids (or by all distances, where it wants a good share of them) and is compared with
the vectors posted there; distances are taken on the original vectors in double precision.

How many lists a query opens is measured, not fixed: `TRIAL_QUERIES` of the queries at most, chosen
by hash, are answered by brute force, and the count is the smallest at which the lists hold `RECALL`
of their true neighbours, `LEAST_PROBES` at least. On vectors without clusters that is a good share
of all lists, so the work then grows like brute force; the share found is not below the target.

Short lists are searched together, as many as hold `part_rows` vectors, and a query finds its nearest
of all it asks there at once; longer lists are searched in parts, and queries that ask one block in
groups of `part_rows`, so a task holds two bounded blocks. Of equal vectors only the k + 1 smallest ids can
be among k nearest (ties go to the smaller id), so only those are posted: a vector that is a third
of the table costs k + 1 rows. Equal query vectors are searched once.

Results for odd input: vectors that are null, zero, hold null or non-finite components, or have
another length than most, take no part, nor do rows with a null id. A row never finds its own id.
Fewer candidates than k: all of them. Rows that repeat id and vector are one candidate. An empty
table gives an empty result. Extra columns are not touched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

SAMPLE_ROWS = 20_000
LIST_ROWS = 256
MOST_LISTS = 16_384
PART_ROWS = 4096
REPLICAS, BOUNDARY = 4, 1.1
LEAST_PROBES, RECALL, TRIAL_QUERIES = 64, 0.99, 256


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (most["d"] if most else 0))


@dataclass
class Lists:
    centers: np.ndarray
    near: np.ndarray  # for each centroid its nearest others, the graph
    entries: np.ndarray

    def walk(self, q: np.ndarray, wanted: int) -> list[tuple[float, int]]:
        """The `wanted` nearest centroids that a best-first walk over the graph finds, nearest first."""
        if 4 * wanted >= len(self.centers):
            d = np.sqrt(((self.centers - q) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")[:wanted]
            return list(zip(d[order].tolist(), order.tolist(), strict=True))
        width = max(2 * wanted, 64)
        d = np.sqrt(((self.centers[self.entries] - q) ** 2).sum(axis=1))
        seen = set(self.entries.tolist())
        open_ = list(zip(d.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(open_)
        best = [(-x, i) for x, i in open_]
        heapq.heapify(best)
        while open_:
            x, i = heapq.heappop(open_)
            if len(best) >= width and x > -best[0][0]:
                break
            new = [j for j in self.near[i].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for y, j in zip(np.sqrt(((self.centers[new] - q) ** 2).sum(axis=1)).tolist(), new, strict=True):
                if len(best) < width or y < -best[0][0]:
                    heapq.heappush(open_, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-x, i) for x, i in best)[:wanted]


def balanced_centers(x: np.ndarray, part: int, most: int, seed: int = 7) -> np.ndarray:
    """Splits x in two, along the line between two means, until parts have `part` rows or cannot be split."""
    rng = np.random.default_rng(seed)
    parts, done = [(-len(x), 0, np.arange(len(x)))], []
    n = 1
    while parts and len(parts) + len(done) < most:
        size, _, rows = heapq.heappop(parts)
        if -size <= part:
            done.append(rows)
            continue
        p = x[rows]
        two = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(8):
            side = ((p - two[1]) ** 2).sum(axis=1) < ((p - two[0]) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            two = np.stack([p[~side].mean(axis=0), p[side].mean(axis=0)])
        along = p @ (two[1] - two[0])
        side = along > np.median(along)  # equal halves keep the lists balanced
        if side.all() or not side.any():
            done.append(rows)
            continue
        for half in (rows[side], rows[~side]):
            n += 1
            heapq.heappush(parts, (-len(half), n, half))
    return np.stack([x[r].mean(axis=0) for r in [*done, *(r for *_, r in parts)]])


def smallest(d: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m smallest values of each row, in order."""
    m = min(m, d.shape[1])
    if not m:
        return np.empty((len(d), 0), np.int64)
    at = np.sort(np.argpartition(d, m - 1, axis=1)[:, :m], axis=1)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)


def fit(v: DataFrame, total: int, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS, most: int = MOST_LISTS, degree: int = 24, seed: int = 29) -> Lists:
    share = min(1.0, sample_rows / max(1, total))
    chosen = v.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    x = np.array([r["v"] for r in chosen.orderBy("id").select("v").limit(2 * sample_rows).collect()], np.float64)  # about sample_rows rows
    if not len(x):
        x = np.array([r["v"] for r in v.orderBy("id").limit(1).collect()], np.float64)
    centers = balanced_centers(x, max(2, int(list_rows * len(x) / max(total, 1))), min(most, max(1, -(-total // list_rows) * 2)))
    k, square = len(centers), (centers**2).sum(axis=1)
    near = np.empty((k, min(degree, max(k - 1, 0))), np.int64)
    for at in range(0, k, 1024):
        d = square[None] - 2 * centers[at : at + 1024] @ centers.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near[at : at + 1024] = smallest(d, near.shape[1])
    rng = np.random.default_rng(seed)
    return Lists(centers, near, np.sort(rng.choice(k, min(k, 16), replace=False)))


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def posted(v: DataFrame, shared, replicas: int = REPLICAS, boundary: float = BOUNDARY) -> DataFrame:
    """(list, id, v): every vector once or, near a boundary, several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value.centers
        square = (centers**2).sum(axis=1)
        for whole in batches:
            step = max(16, (1 << 21) // len(centers))  # 16 MiB of distances at a time
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _stacked(batch.column(1))
                d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + square[None] - 2 * x @ centers.T, 0))
                first = smallest(d, 4 * replicas)
                rows, lists = [], []
                for i, order in enumerate(first):
                    chosen: list[int] = []
                    for c in order:
                        if len(chosen) == replicas or (chosen and d[i, c] > boundary * d[i, chosen[0]]):
                            break
                        if not chosen or ((centers[chosen] - centers[c]) ** 2).sum(axis=1).min() > d[i, c] ** 2:
                            chosen.append(int(c))
                    rows += [i] * len(chosen)
                    lists += chosen
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "id", "v"])

    return v.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "list int, id long, v array<double>")


def true_neighbours(v: DataFrame, q: np.ndarray, k: int) -> DataFrame:
    """(row, id): the k nearest of all of v for each row of q, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            if batch.num_rows:
                new = block_nearest(q, _stacked(batch.column(1)), batch.column(0).to_numpy(), k)
                rows, ids, score = (np.concatenate(two) for two in zip((rows, ids, score), new, strict=True))
                order = np.lexsort((ids, score, rows))
                rows, ids, score = rows[order], ids[order], score[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, ids, score = (part[place < k] for part in (rows, ids, score))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids), pa.array(score)], names=["row", "id", "score"])

    found = v.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "row long, id long, score double")
    order = F.row_number().over(W.partitionBy("row").orderBy("score", "id"))
    return found.withColumn("n", order).where(F.col("n") <= k).select("row", "id", "n")


def probes_for(kinds: DataFrame, some: DataFrame, postings: DataFrame, index: Lists, k: int, recall: float = RECALL, trials: int = TRIAL_QUERIES, seed: int = 31) -> int:
    """How many lists a query must open so that `recall` of the true neighbours of the trial queries are met."""
    lists = len(index.centers)
    least = min(LEAST_PROBES, lists)
    if least == lists:
        return lists
    trial = kinds.orderBy(F.xxhash64(F.lit(seed), "q"), "q").limit(trials).collect()
    if not trial:
        return least
    q = np.array([r["v"] for r in trial], np.float64)
    pairs: list[tuple[int, int]] = []
    met = [0] * len(trial)
    for r in true_neighbours(some, q, k + 1).orderBy("row", "n").collect():  # trials x (k + 1) rows
        if r["id"] != trial[r["row"]]["q"] and met[r["row"]] < k:
            met[r["row"]] += 1
            pairs.append((r["row"], r["id"]))
    if not pairs:
        return least
    ids = some.sparkSession.createDataFrame(sorted({(i,) for _, i in pairs}), "id long")
    held: dict[int, list[int]] = {}
    for r in postings.join(F.broadcast(ids), "id").select("id", "list").collect():  # REPLICAS rows an id at most
        held.setdefault(r["id"], []).append(r["list"])

    def ranks(probes: int) -> list[int]:
        found = [{c: n for n, (_, c) in enumerate(index.walk(x, probes), 1)} for x in q]
        return sorted(min(found[row].get(c, lists + 1) for c in held[i]) for row, i in pairs)

    last = -(-int(recall * 10_000) * len(pairs) // 10_000) - 1
    probes = max(least, ranks(lists)[last])
    while probes < lists and ranks(probes)[last] > probes:  # the walk over the graph may miss some
        probes = min(lists, probes + probes // 4)
    return probes


def blocks_of(sizes: dict[int, int]) -> dict[int, int]:
    """The block of each list: as many lists as hold PART_ROWS vectors, or one longer list alone."""
    out: dict[int, int] = {}
    at, held = 0, 0
    for c, n in sorted(sizes.items()):
        if held and held + n > PART_ROWS:
            at, held = at + 1, 0
        out[c], held = at, held + n
    return out


def asked(queries: DataFrame, shared, sizes: dict[int, int], blocks: dict[int, int], wanted: int, probes: int) -> DataFrame:
    """(block, q, lists, v): the lists that each query vector (q, v) is compared with, a row for each block:
    the `probes` nearest, and more until they hold `wanted` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, where, lists = [], [], []
            for i, x in enumerate(_stacked(batch.column(1))):
                held, near = 0, index.walk(x, probes)
                if sum(sizes.get(c, 0) for _, c in near) < wanted:
                    near = index.walk(x, len(index.centers))
                mine: dict[int, list[int]] = {}
                for n, (_, c) in enumerate(near):
                    if n >= probes and held >= wanted:
                        break
                    if sizes.get(c):
                        held += sizes[c]
                        mine.setdefault(blocks[c], []).append(c)
                rows += [i] * len(mine)
                where += mine.keys()
                lists += mine.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), batch.column(0).take(take), pa.array(lists, pa.list_(pa.int32())), batch.column(1).take(take)], names=["block", "q", "lists", "v"])

    return queries.select("q", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "block int, q long, lists array<int>, v array<double>")


def block_nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest of x, ties to the smaller id."""
    rows, found, score = [], [], []
    square = (x**2).sum(axis=1)
    for i, one in enumerate(q):
        d = square - 2 * x @ one
        if len(d) > k:
            cut = np.partition(d, k - 1)[k - 1]
            near = np.flatnonzero(d <= cut + 1e-9 * (abs(cut) + square.max() + 1))
        else:
            near = np.arange(len(d))
        exact = np.sqrt(((x[near] - one) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], exact))[:k]
        rows.append(np.full(len(order), i))
        found.append(ids[near][order])
        score.append(exact[order])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(score)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score for each row whose id is divisible by `every`, against all rows."""
    v = written(usable(vectors, id_col, vector_col).distinct(), "vectors")
    order = F.row_number().over(W.partitionBy("v").orderBy("id"))
    some = written(v.withColumn("n", order).where(F.col("n") <= k + 1).select("id", "v"), "few")
    total = some.count()
    empty = v.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    if not total:
        return empty
    index = fit(some, total)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids at most
    postings = written(posted(some, shared), "postings")
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list
    queries = v.where(F.col("id") % every == 0)
    kinds = queries.groupBy("v").agg(F.min("id").alias("q"))
    count = probes_for(kinds, some, postings, index, k)
    blocks = blocks_of(sizes)
    probes = written(asked(kinds, shared, sizes, blocks, 2 * REPLICAS * (k + 1), count), "probes")
    asks = {r["block"]: r["n"] for r in probes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asks:
        return empty
    rows_in: dict[int, int] = {}
    for c, n in sizes.items():
        rows_in[blocks[c]] = rows_in.get(blocks[c], 0) + n
    parts = [(c, b, -(-rows_in[b] // PART_ROWS), -(-asks[b] // PART_ROWS)) for c, b in blocks.items() if b in asks]
    facts = F.broadcast(vectors.sparkSession.createDataFrame(parts, "list int, block int, parts int, groups int"))  # a row for each list

    def dealt(rows: DataFrame, own: str, other: str, own_name: str, other_name: str, key: str) -> DataFrame:
        rows = rows.withColumn(own_name, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return rows.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    one = F.broadcast(facts.drop("list").distinct())
    left = dealt(probes.join(one, "block"), "groups", "parts", "g", "p", "q").select("block", "p", "g", "q", "lists", "v")
    right = dealt(postings.join(facts, "list"), "parts", "groups", "p", "g", "id").select("block", "p", "g", "list", "id", "v")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return none
        b = b.sort_values(["list", "id"])
        x, ids = np.stack(b["v"].to_numpy()), b["id"].to_numpy()
        held, starts = np.unique(b["list"].to_numpy(), return_index=True)
        ranges = {int(c): np.arange(s, e) for c, s, e in zip(held, starts, [*starts[1:], len(b)], strict=True)}
        replicated = len(np.unique(ids)) < len(ids)
        made = []
        for q, lists, v in zip(a["q"], a["lists"], a["v"], strict=True):
            at = [ranges[c] for c in lists if c in ranges]
            if not at:
                continue
            at = np.concatenate(at)
            if replicated:
                at = at[np.unique(ids[at], return_index=True)[1]]
            _, near, score = block_nearest(v[None], x[at] if len(at) < len(x) else x, ids[at] if len(at) < len(x) else ids, k + 1)
            made.append(pd.DataFrame({"q": q, "id": near, "score": score}))
        return pd.concat(made) if made else none

    on = ["block", "p", "g"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, "q long, id long, score double")
    found = found.groupBy("q", "id").agg(F.min("score").alias("score"))
    few = F.row_number().over(W.partitionBy("q").orderBy("score", "id"))
    found = found.withColumn("n", few).where(F.col("n") <= k + 1).drop("n")
    mine = queries.join(kinds, "v").select(F.col("id").alias("query_id"), "q").distinct()
    out = mine.join(found, "q").where("id <> query_id").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
