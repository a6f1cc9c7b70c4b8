"""Exact top-k by inner product: the threshold algorithm over sorted lists, one per dimension.

A block of candidates keeps, for each dimension, its rows sorted by that component. For a query, all lists are read from
the end that is best for the sign of the query's component. Every row met for the first time is scored in full. The
threshold, which is the score that a row with all components as they stand at the current depth would have, bounds every row
not yet met; reading stops when it cannot beat the kth best score so far. Ties go to the smaller id, so a threshold that
equals the kth score does not stop it. The depth doubles at each step, so that steps are few and NumPy does the work.

Candidates are numbered into blocks of about ``rows_block`` rows; every query goes to every block, and meets it in one
task that has built the block's lists once, before its first query. So a task holds one block and ``query_block`` queries
at a time, the driver nothing, and all of it is one shuffle. Blocks keep k rows a query, which are merged by a grouped rank.

Defined results: vectors that are null, empty, or hold null or non-finite components, and null ids, take no part; a query
meets only vectors of its own length, and none with its own id; fewer candidates than k give all of them. Queries that
agree in id and vector are one query; those of one id and different vectors are ranked each for itself. Repeated
candidates are ranked each for itself, ties among them in any order. Scores are exact; only a score among the k best that
is beyond 64 bits is an error. A query condition that is null is false. Other columns serve the condition only.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: float64 adds and multiplies integers exactly below this, int64 below that.
EXACT, LONG = 1 << 53, 1 << 63


class SortedLists:
    """A block of candidates of one length (int64), sorted by every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.most = max(abs(int(rows.min())), abs(int(rows.max())))
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()  # a list of rows per dimension, ascending
        self.values = np.take_along_axis(rows.T, self.order, axis=1)
        self.floats = rows.astype(np.float64)

    def search(self, query: np.ndarray, own: int | None, k: int, first: int = 16) -> list[tuple[int, int]]:
        """The k best (score, id) for a query (int64), best first."""
        n, dims = self.rows.shape
        used = np.flatnonzero(query)
        down = query[used] > 0
        bound = self.most * max(abs(int(query.min())), abs(int(query.max()))) * dims
        kind = np.float64 if bound < EXACT else np.int64 if bound < LONG else object
        rows, q = self.floats if kind is np.float64 else self.rows, query.astype(kind)
        seen, depth, top = np.zeros(n, bool), 0, []
        step = first
        while depth < n:
            to = min(n, depth + step)
            fresh = np.zeros(n, bool)
            for best_last, at in ((True, used[down]), (False, used[~down])):
                if len(at):
                    part = self.order[at, n - to : n - depth] if best_last else self.order[at, depth:to]
                    fresh[part] = True
            if not len(used):
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            if len(new):
                scores = rows[new].astype(kind, copy=False) @ q
                if own is not None:
                    keep = self.ids[new] != own
                    new, scores = new[keep], scores[keep]
                if len(new) > k:  # all that may be among the k best, ties included
                    floor = np.partition(scores, len(new) - k)[len(new) - k]
                    keep = scores >= floor
                    new, scores = new[keep], scores[keep]
                top = sorted([*top, *((-int(s), int(i)) for s, i in zip(scores, self.ids[new]))])[:k]
            depth, step = to, step * 2
            if depth < n and len(top) == k:
                edge = np.where(down, self.values[used, n - depth - 1], self.values[used, depth])
                if int(edge.astype(kind) @ q[used]) < -top[-1][0]:
                    break
            if seen.all():
                break
        if any(not -LONG <= -s < LONG for s, _ in top):
            raise OverflowError("a score is beyond 64 bits")
        return [(-s, i) for s, i in top]


def usable(vector: str) -> "F.Column":
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _vectors(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """The rows of each length: the length, vectors as a matrix, their rows, and which of these they are."""
    if not parts:
        return
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    lists = whole.column("v")
    lengths = np.array(lists.value_lengths())
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, flat[offsets[at][:, None] + np.arange(d)], whole, at


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Stretches of at most ``most`` rows of one block, of candidates or of queries: the block, whether these are queries, the rows."""
    for batch in batches:
        block, query = batch.column("block").to_numpy(), batch.column("q").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            for at in range(a, b, most):
                yield int(block[a]), bool(query[a]), batch.slice(at, min(b, at + most) - at)


OUT = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "vector", k: int = 5, query_block: int = 4096, rows_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every query. ``vector_col`` holds arrays of whole numbers.

    ``is_query`` is an SQL condition over the columns of ``vectors``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.expr(is_query).alias("wanted"))
    good = rows.filter(F.col("id").isNotNull() & usable("v")).withColumn("v", F.col("v").cast("array<bigint>"))
    blocks = max(1, math.ceil(good.count() / rows_block))
    asked = spool(good.filter("wanted").select("id", "v").distinct().withColumn("q", F.monotonically_increasing_id()))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "q", "id", "v")
    # numbered by place, so that repeated rows do not share a block
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    both = good.select(block.alias("block"), F.lit(None).cast("long").alias("q"), "id", "v").unionByName(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, candidates first."""
        at, candidates, lists = None, [], None
        for block, query, part in _stretches(batches, query_block):
            if block != at:
                at, candidates, lists = block, [], None
            if not query:
                candidates.append(part)
                continue
            if lists is None:
                lists, candidates = {d: SortedLists(whole.column("id").to_numpy()[i], m) for d, m, whole, i in _vectors(candidates)}, []
            made: dict[str, list] = {x: [] for x in OUT.names}
            for d, matrix, whole, i in _vectors([part]):
                if d in lists:
                    for q, own, v in zip(whole.column("q").to_numpy()[i].tolist(), whole.column("id").to_numpy()[i].tolist(), matrix):
                        for score, other in lists[d].search(v, own, k):
                            for x, y in zip(OUT.names, (q, own, other, score)):
                                made[x].append(y)
            yield pa.RecordBatch.from_pydict(made, schema=OUT)

    dealt = both.repartition("block").sortWithinPartitions("block", F.col("q").asc_nulls_first())
    found = dealt.mapInArrow(search, "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
