"""Bulk-synchronous best-fit packing of documents into sequences of bounded length.

A document's token ids (and an end id) are cut into pieces only where they are longer than a sequence. Pieces are sorted
by length: each gets its rank among the pieces of its length, from counts by (length, bucket) and ranks inside a bucket,
so that no length is gathered in one task. Lengths and gaps lie between 1 and ``length``, so the state that a superstep
works on is two arrays of at most that many classes, whatever the corpus. A superstep takes the longest class not yet
placed, sweeps over the gap classes from the successor of its length upwards, matches pieces to gaps by rank (piece
number i of the class to gap number i, so no two pieces want the same gap), opens new sequences for those that no gap
holds, and updates the gaps; this repeats until all classes are placed, which gives the result of best-fit decreasing.
Every piece then finds its sequence from its rank alone: the matches are intervals of ranks, at most a few for each
class, and are sent to the tasks as arrays. The sweep over classes runs on the driver, since its state is bounded by
``length`` and not by the corpus; sorting, ranking and placing are distributed.

Defined results: null texts are empty, and a document without ids still has its end id; repeated rows and ids are packed
each for itself; null ids stay null; an empty table gives an empty one; other columns of ``docs`` are not read.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at_work, slices, spool
from .word_ids import WordIds

PIECES = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECE_FIELDS = "doc_id long, rid long, piece int, start long, length long, ids_crc32 long, ids binary"


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def begin() -> None:
    at_work("packing", word_ids.cache_clear)


def id_bits(path: str, end_id: int = 0) -> int:
    """Bits of an id in ``ids``."""
    return 16 if max(end_id + 1, word_ids(path).tokenizer.get_vocab_size()) <= 1 << 16 else 32


def pieces(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """A row per piece of at most ``length`` ids of each document and its end id.

    doc_id, rid (a number for the row), piece, start, length, ids_crc32 (of the ids as little-endian 32 bits each), ids
    (little-endian, 16 bits each where the vocabulary and the end id fit, 32 otherwise; see ``id_bits``).
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        end, narrow = np.array([end_id], "<u4").tobytes(), id_bits(path, end_id) == 16
        for part in slices(batches, "text", 1 << 22):
            made: dict[str, list] = {x: [] for x in PIECES.names}
            encoded = word_ids(path).encode(part.column("text").fill_null(""))
            for key, rid, data in zip(part.column("doc_id").to_pylist(), part.column("rid").to_pylist(), encoded):
                data += end
                for i, at in enumerate(range(0, len(data), 4 * length)):
                    cut = data[at : at + 4 * length]
                    ids = np.frombuffer(cut, "<u4").astype("<u2").tobytes() if narrow else cut
                    for name, v in zip(PIECES.names, (key, rid, i, at // 4, len(cut) // 4, zlib.crc32(cut), ids)):
                        made[name].append(v)
            yield pa.RecordBatch.from_pydict(made, schema=PIECES)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE_FIELDS)


def supersteps(counts: dict[int, int], length: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches (class, first rank, first sequence, offset, ranks to a sequence) and the number of sequences.

    Piece number ``first + i`` of a class goes to sequence ``sequence + i // ranks``, at ``offset + i % ranks * class``.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: runs of sequences (first, how many)
    matches, used = [], 0
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        while left:
            fits = next((g for g in range(size, length) if gaps.get(g)), None)
            if fits is not None:
                first, n = gaps[fits].pop()
                take = min(n, left)
                if take < n:
                    gaps[fits].append((first + take, n - take))
                matches.append((size, rank, first, length - fits, 1))
                if fits > size:
                    gaps[fits - size].append((first, take))
            else:
                # none holds it: new sequences, each filled with pieces of the class, as best fit would one by one
                each = length // size
                full, over = divmod(left, each)
                n = full or 1
                take, per = (full * each, each) if full else (left, over)
                matches.append((size, rank, used, 0, per))
                if (rest := length - per * size) > 0:
                    gaps[rest].append((used, n))
                used += n
            left, rank = left - take, rank + take
    return matches, used


def pack(docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, bucket: int = 512) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, ids (as ``pieces`` gives them), sequence_id, offset.

    The pieces of a sequence, in order of offset, are its tokens without a gap. Classes of more than ``bucket`` pieces are
    ranked in several buckets.
    """
    cut = spool(pieces(docs, length, id_col, text_col, tokenizer, end_id))
    # at most ``length`` rows
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    matches, _ = supersteps(counts, length)
    order = sorted(matches)
    key = np.array([(s << 44) + r for s, r, *_ in order], np.int64)
    table = np.array([m[1:] for m in order], np.int64).reshape(-1, 4)
    shared = docs.sparkSession.sparkContext.broadcast((key, table))
    buckets = docs.sparkSession.createDataFrame([(s, -(-n // bucket)) for s, n in counts.items()], "length long, buckets long")
    salted = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), F.col("buckets"))).drop("buckets")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = spool(salted.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid", "piece"))
    ranked = salted.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + rank - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, table = shared.value
        m = table[np.searchsorted(key, (size.to_numpy() << 44) + rank.to_numpy(), side="right") - 1]
        i = rank.to_numpy() - m[:, 0]
        return pd.DataFrame({"sequence_id": m[:, 1] + i // m[:, 3], "offset": m[:, 2] + i % m[:, 3] * size.to_numpy()})

    out = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    return ranked.select(*out, place("length", "rank").alias("place")).select(*out, "place.*")
