"""Operator 4: approximate nearest neighbours by inner product, over balanced posting lists.

Vectors get one more component, so that all have the largest norm and the
nearest by distance is the largest by inner product. Balanced clusters of a
bounded sample give the centroids; every vector goes to its nearest centroid's
posting list and, near a boundary, also to those of others. A query finds its
lists by a best-first search of the centroids' neighbour graph, keeps those
whose distance is within a ratio of the nearest one's, and is compared with
every vector of these lists in double precision. How many lists a query reads
is settled at every fit: a bounded number of the queries is compared with all
vectors, and the ratio, or the number of lists, is raised until the lists that
these queries read hold enough of their true neighbours.

Equal vectors stand in a list once, by their smallest id, with as many ids as a
result can hold. A list that outgrows a bound is dealt into shards, and the
queries of a list that many ask into parts; each list has its own numbers of
them. Nothing but the sample, the centroids and their graph, and the queries
that recall is measured on with their neighbours, all bounded by parameters, is
held by the driver or broadcast.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another length than most have; ties go to the smaller
id; repeated rows of an id count once for each distinct vector; fewer candidates
than asked for are all given; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tryloom.llm.chunks import column
from tryloom.llm.shared import cut, table, written

#: Vectors a list should hold, and lists at most (their centroids are held in memory).
LIST_SIZE, MOST_LISTS = 200, 8192
#: Vectors for each list that its centroid is fitted on, and vectors drawn at least.
SAMPLE_A_LIST, LEAST_SAMPLE = 8, 20_000
#: Vectors, and queries, of one list that a group may hold; larger lists are dealt into several groups.
SHARD_SIZE, QUERIES_SIZE = 4096, 4096
#: Distances that are held at once.
CELLS = 4 << 20
#: Lists that every query reads.
LEAST_LISTS = 8
#: Queries that recall is measured on, at most, and the recall that they must have.
PROBES, RECALL = 200, 0.95
#: Centroids of a point's pool that are expanded at once, and its nearest that are expanded in any case.
EXPANDED, POOL = 2, 4
#: Vectors searched for together.
BLOCK = 1024


@dataclass
class Centroids:
    """Cluster centres of extended vectors and, for each, its neighbours in the graph."""

    points: np.ndarray
    graph: np.ndarray
    norm: float

    def extended(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        squares = (vectors**2).sum(axis=1)
        if queries:  # a query's length changes no order
            return np.hstack([vectors * (self.norm / np.sqrt(squares))[:, None], np.zeros((len(vectors), 1))])
        return np.hstack([vectors, np.sqrt(np.maximum(self.norm**2 - squares, 0))[:, None]])

    def within(self, points: np.ndarray, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a point and a centroid, and their distances.

        The centroid is at most ``ratio`` times as far as the nearest one, or
        among the nearest ``least``. A best-first search of the graph expands
        every such centroid, a few of a point at a time and all points at once;
        it looks at the neighbours of these, and at no other centroid.
        """
        many, size = len(self.points), len(points)

        def bounds(reach: np.ndarray, least: int) -> np.ndarray:
            """How far each row's distances, in order, may go."""
            return np.maximum(reach[:, :1] * ratio**2 + 1e-12, reach[:, [least - 1]] if least <= reach.shape[1] else np.inf)

        squares = (self.points**2).sum(axis=1)
        own = (points**2).sum(axis=1)
        # Entries spread over the centroids, which stand in order of the halving.
        entries = np.unique(np.linspace(0, many - 1, min(many, 8 + math.isqrt(many))).astype(int))
        seen = np.zeros((size, many), bool)
        seen[:, entries] = True
        # Each point's pool: what it has met within its bound, nearest first, and what of it is not expanded yet.
        ids = np.broadcast_to(entries, (size, len(entries)))
        reach = np.maximum(own[:, None] + squares[entries] - 2 * points @ self.points[entries].T, 0)
        fresh = np.ones(ids.shape, bool)
        going = np.arange(size)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(going):
            order = np.argsort(reach, axis=1, kind="stable")
            reach = np.take_along_axis(reach, order, 1)
            # A bound only falls, so what is beyond it is forgotten.
            bound = bounds(reach, max(least, POOL))
            inside = (reach <= bound) & np.isfinite(reach)
            width = int(inside.sum(axis=1).max())
            order, reach, inside = order[:, :width], reach[:, :width], inside[:, :width]
            ids = np.take_along_axis(ids, order, 1)
            fresh = np.take_along_axis(fresh, order, 1) & inside
            more = fresh.any(axis=1)
            if not more.all():
                row, at = np.nonzero(inside & ~more[:, None] & (reach <= bounds(reach, least)))
                done.append((going[row], ids[row, at], reach[row, at]))
                going, ids, reach, fresh = going[more], ids[more], reach[more], fresh[more]
                if not len(going):
                    break
            # The nearest that are not expanded yet.
            turn = fresh & (np.cumsum(fresh, axis=1) <= EXPANDED)
            fresh &= ~turn
            row, at = np.nonzero(turn)
            near = self.graph[ids[row, at]]
            pair = np.unique((row[:, None] * many + near)[~seen[going[row][:, None], near]])
            row, near = pair // many, pair % many
            seen[going[row], near] = True
            found = np.maximum(own[going[row]] + squares[near] - 2 * np.einsum("nd,nd->n", points[going[row]], self.points[near]), 0)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            wide = int(place.max()) + 1 if len(row) else 0
            met, far = np.zeros((len(going), wide), ids.dtype), np.full((len(going), wide), np.inf)
            met[row, place], far[row, place] = near, found
            ids, reach, fresh = np.hstack([ids, met]), np.hstack([reach, far]), np.hstack([fresh, np.ones(far.shape, bool)])
        row, at, reach = (np.concatenate([d[i] for d in done]) if done else np.empty(0, int) for i in range(3))
        return row, at, np.sqrt(reach)


def balanced(points: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centres of about ``lists`` clusters of like size.

    Halves are cut at the median along their main axis until there are enough;
    then a few rounds move the centres, with sizes held together by a price for
    full clusters.
    """
    parts = [np.arange(len(points))]
    while len(parts) < lists:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        centred = points[part] - points[part].mean(axis=0)
        axis = centred[np.abs(centred).sum(axis=1).argmax()]
        for _ in range(8):
            axis = centred.T @ (centred @ axis)
            axis /= max(np.linalg.norm(axis), 1e-30)
        order = part[np.argsort(centred @ axis, kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    centres = np.stack([points[p].mean(axis=0) for p in parts])
    price = np.zeros(len(centres))
    step = max(1, CELLS // len(centres))
    for _ in range(rounds):
        squares, owner, spreads = (centres**2).sum(axis=1), np.empty(len(points), np.int64), []
        for begin in range(0, len(points), step):
            reach = squares - 2 * points[begin : begin + step] @ centres.T
            spreads.append(np.ptp(reach, axis=1))
            owner[begin : begin + step] = (reach + price).argmin(axis=1)
        sizes = np.bincount(owner, minlength=len(centres))
        spread = np.median(np.concatenate(spreads)) if len(centres) > 1 else 0
        price += 0.02 * spread * (sizes * len(centres) / len(points) - 1).clip(-1, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def matrix(values: pa.Array) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the vectors that take part."""
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = good.where(~F.coalesce(odd, F.lit(True)) & some).select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    most = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return good.where(F.size("v") == (most["d"] if most else 0))


def neighbours(points: np.ndarray, degree: int) -> np.ndarray:
    """For each of ``points``, at most ``degree`` others and the next one of a ring."""
    squares = (points**2).sum(axis=1)
    many = len(squares)
    # Half of a centroid's neighbours are its nearest; the others stand at ranks in geometric steps, so that few steps lead anywhere.
    ranks = np.unique(np.concatenate([np.arange(degree // 2), np.geomspace(max(1, degree // 2), max(1, many - 2), degree - degree // 2).astype(int)]))
    ranks = ranks[ranks < many - 1]
    # Last comes the next centroid of a ring, so that a search can reach every list.
    graph = np.empty((many, len(ranks) + 1), int)
    graph[:, -1] = np.roll(np.arange(many), -1)
    step = max(1, CELLS // many)
    for begin in range(0, many, step):
        reach = squares - 2 * points[begin : begin + step] @ points.T
        reach[np.arange(len(reach)), np.arange(begin, begin + len(reach))] = np.inf
        graph[begin : begin + step, :-1] = np.argsort(reach, axis=1, kind="stable")[:, ranks]
    return graph


def fit(reps: DataFrame, n: int, norm: float, list_size: int = LIST_SIZE, degree: int = 24) -> Centroids:
    """Centroids from a sample of the ``n`` vectors, drawn by a hash of their ids.

    Lists and the sample grow with ``n``, up to ``MOST_LISTS`` lists.
    """
    lists = max(1, min(n // list_size, MOST_LISTS))
    sample = max(LEAST_SAMPLE, lists * SAMPLE_A_LIST)
    drawn = matrix(reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow().column("v"))
    found = Centroids(np.empty((0, 0)), np.empty((0, 0), int), norm)
    found.points = balanced(found.extended(drawn, False), lists)
    found.graph = neighbours(found.points, degree)
    return found


def routed(rows: DataFrame, centroids: Centroids, queries: bool, ratio: float, copies: int | None = None, least: int = 1) -> DataFrame:
    """``list``, ``near`` (its place among the row's lists), ``rep`` and ``v``: each vector with the lists within ``ratio`` of its nearest centroid's distance.

    At most the nearest ``copies`` of them, if that is given, and the nearest ``least`` in any case.
    """

    step = min(BLOCK, max(1, CELLS // len(centroids.points)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                row, at, reach = centroids.within(centroids.extended(matrix(column(part, "v")), queries), ratio, least)
                order = np.lexsort((reach, row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                if copies:
                    row, at, place = row[place < copies], at[place < copies], place[place < copies]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)), column(taken, "rep"), column(taken, "v")], names=["list", "near", "rep", "v"])

    return rows.select("rep", "v").mapInArrow(route, f"list int, near int, rep long, v {rows.schema['v'].dataType.simpleString()}")


def answers(lists: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``q``, ``rep`` and ``score``: the ``k`` best of each query within each shard of each of its lists.

    Where a query has a ``bound``, only what scores as much is given.
    """

    def search(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": [], "rep": [], "score": []}).astype({"q": "int64", "rep": "int64", "score": "float64"})
        if not len(posted) or not len(asked):
            return empty
        posted = posted.sort_values("rep")
        reps = posted["rep"].to_numpy()
        vectors = np.stack(posted["v"].to_numpy()).astype(np.float64)
        out = [empty]
        for begin in range(0, len(asked), BLOCK):
            part = asked.iloc[begin : begin + BLOCK]
            scores = np.stack(part["v"].to_numpy()).astype(np.float64) @ vectors.T
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            # a little below the bound, for sums that differ in their last digits
            least = np.maximum(least, part["bound"].to_numpy() - 1e-9)
            row, at = np.nonzero(scores >= least[:, None])
            order = np.lexsort((at, -scores[row, at], row))
            row, at = row[order], at[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, at = row[place < k], at[place < k]
            out.append(pd.DataFrame({"q": part["rep"].to_numpy()[row], "rep": reps[at], "score": scores[row, at]}))
        return pd.concat(out)

    return lists.groupBy("list", "shard", "part").cogroup(queries.groupBy("list", "shard", "part")).applyInPandas(search, "q long, rep long, score double")


def true_nearest(reps: DataFrame, probes: np.ndarray, points: np.ndarray, k: int) -> DataFrame:
    """``q``, ``rep`` and ``score``: of each probe, by its id and vector, the ``k`` best others of all vectors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, scores = np.empty((len(probes), 0), np.int64), np.empty((len(probes), 0))
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                ids = column(part, "rep").to_numpy()
                found = np.where(ids == probes[:, None], -np.inf, points @ matrix(column(part, "v")).T)
                reps, scores = np.hstack([reps, np.broadcast_to(ids, found.shape)]), np.hstack([scores, found])
                if scores.shape[1] > k:
                    kept = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    reps, scores = np.take_along_axis(reps, kept, 1), np.take_along_axis(scores, kept, 1)
        row, at = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(probes[row]), pa.array(reps[row, at]), pa.array(scores[row, at])], names=["q", "rep", "score"])

    found = reps.select("rep", "v").mapInArrow(search, "q long, rep long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    return found.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def reading(centroids: Centroids, points: np.ndarray, held: pd.DataFrame, ratio: float, recall: float = RECALL, least: int = LEAST_LISTS) -> tuple[float, int]:
    """The ratio and the number of nearest lists, at least those given, with which ``points`` find a share ``recall`` of their neighbours.

    ``held`` has ``q`` (a row of ``points``), ``rep`` and ``list`` of each
    neighbour's postings. Of a higher ratio and more nearest lists, that is
    taken which reads fewer lists; then a search of the graph confirms it.
    """
    many = len(centroids.points)
    reach = np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + (centroids.points**2).sum(axis=1) - 2 * points @ centroids.points.T, 0))
    ratios = reach / np.maximum(reach.min(axis=1), 1e-9)[:, None]
    ranks = reach.argsort(axis=1, kind="stable").argsort(axis=1)
    q, at = held["q"].to_numpy(), held["list"].to_numpy()
    far, rank = ratios[q, at], ranks[q, at]
    enough = lambda needs: needs.groupby([held["q"], held["rep"]]).min().quantile(recall, "higher")
    wider = max(ratio, enough(pd.Series(np.where(rank < least, 0.0, far), held.index)))
    more = max(least, enough(pd.Series(np.where(far <= ratio, 0, rank + 1), held.index)))
    reads = lambda r, n: ((ratios <= r) | (ranks < n)).sum()
    ratio, least = (wider, least) if reads(wider, least) <= reads(ratio, more) else (ratio, int(more))
    while least < many:
        read = np.zeros(reach.shape, bool)
        read[centroids.within(points, ratio, least)[:2]] = True
        if pd.Series(read[q, at]).groupby([q, held["rep"].to_numpy()]).max().mean() >= recall:
            break
        ratio, least = ratio * 1.02, min(many, least + -(-least // 4))
    return float(ratio), least


@dataclass
class Index:
    """Vectors by value (``reps``), their posting lists, who asks, and how many lists a query reads."""

    good: DataFrame
    reps: DataFrame
    centroids: Centroids
    posted: DataFrame
    asked: DataFrame
    wanted: DataFrame
    ratio: float
    least: int

    def routes(self) -> DataFrame:
        return routed(self.wanted, self.centroids, True, self.ratio, least=self.least)


def index(vectors: DataFrame, queries: DataFrame, k: int, copies: int, boundary: float, prune: float) -> Index | None:
    """Posting lists of all of ``vectors``, and the lists to read for ``queries``, settled by recall; None without a vector."""
    good = written(usable(vectors), "vectors")
    reps = written(good.groupBy("v").agg(F.min("vec_id").alias("rep")), "vector-reps")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = reps.agg(F.count("*").alias("n"), F.max(squares).alias("most")).first()
    if not whole["n"]:
        return None
    centroids = fit(reps, whole["n"], math.sqrt(whole["most"]))
    posted = written(routed(reps, centroids, False, boundary, copies).drop("near"), "postings")
    asked = usable(queries).join(reps, "v").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    wanted = reps.join(asked.select("rep").distinct(), "rep", "left_semi")
    probes = wanted.orderBy(F.xxhash64("rep"), "rep").limit(PROBES).toArrow()
    least = LEAST_LISTS
    if probes.num_rows:
        ids, points = probes.column("rep").to_numpy(), matrix(probes.column("v"))
        held = F.broadcast(true_nearest(reps, ids, points, k)).join(posted.select("rep", "list"), "rep").select("q", "rep", "list").toPandas()
        if len(held):
            held["q"] = pd.Index(ids).get_indexer(held["q"])
            prune, least = reading(centroids, centroids.extended(points, True), held, prune)
    return Index(good, reps, centroids, posted, asked, wanted, prune, least)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, copies: int = 4, boundary: float = 1.05, prune: float = 1.15) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest of each of ``queries`` among ``vectors``.

    ``boundary`` and ``copies`` govern the replication into further lists,
    ``prune`` the least choice of the lists that a query reads, which is widened
    until the measured recall is at least ``RECALL``.
    """
    made = index(vectors, queries, k, copies, boundary, prune)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    routes = written(made.routes(), "routes")
    # Each list has its own number of shards of vectors and of parts of queries; every part meets every shard.
    groups = lambda rows, most, name: rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    cuts = F.broadcast(cut(groups(made.posted, SHARD_SIZE, "shards").join(groups(routes, QUERIES_SIZE, "parts"), "list")))  # a row a list
    own = lambda name: F.pmod(F.xxhash64("rep"), F.col(name)).cast("int")
    all_ = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    dealt = made.posted.join(cuts, "list").select("list", "rep", "v", own("shards").alias("shard"), all_("parts").alias("part"))
    sent = routes.join(cuts, "list").select("list", "near", "rep", "v", own("parts").alias("part"), all_("shards").alias("shard"))

    # One more than k: the query's own id is among them.
    best = lambda df, by, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k + 1).drop("_n")
    once = lambda df: df.groupBy("q", "rep").agg(F.max("score").alias("score"))
    # The nearest lists give a bound for each query; the others answer only with what reaches it.
    none = F.lit(float("-inf"))
    first = written(best(once(answers(dealt, sent.where(F.col("near") < LEAST_LISTS).withColumn("bound", none), k + 1)), "q", F.desc("score"), "rep"), "nearest-first")
    bounds = first.groupBy(F.col("q").alias("rep")).agg(F.count("*").alias("n"), F.min("score").alias("least")).select("rep", F.when(F.col("n") > k, F.col("least")).otherwise(none).alias("bound"))
    others = answers(dealt, sent.where(F.col("near") >= LEAST_LISTS).join(bounds, "rep"), k + 1)
    found = best(once(first.unionByName(others)), "q", F.desc("score"), "rep")
    # The smallest ids of each vector; the limit also holds within each task, before the shuffle.
    members = best(made.good.select("v", "vec_id").distinct(), "v", "vec_id").join(made.reps, "v").select("rep", "vec_id")
    each = best(found.join(members, "rep").select("q", "vec_id", "score"), "q", F.desc("score"), "vec_id")
    rows = made.asked.withColumnRenamed("rep", "q").join(each, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
