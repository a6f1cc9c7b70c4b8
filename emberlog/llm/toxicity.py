"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbours, and pairs with one word between, hashed to ``2 ** bits``
places. Training keeps two numbers for a place, with a learning rate of its own; the L1 term leaves most weights at
zero, so the model is a short sorted list of places and weights, whose size is bounded by the sample.

Training uses at most ``sample`` labelled rows, those with the smallest hash of the id, in one task; everything else is
a single pass over whole texts. Words are runs of letters and digits in lower case.

Defined results: null and empty texts have no features and get the score of the bias; labels that are null or belong to
no document are ignored, of contradicting labels of an id the largest counts; without any usable label every score is 0;
repeated rows are scored each for itself; an empty table gives an empty one; a column of the score's name is replaced, all
others stay, whatever their names. Rows of the sample that tie in their hash go by id.
"""
from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work

SAMPLE = 12_000
BITS = 20
TOKEN = regex.compile(r"[\p{L}\p{N}]+")
#: Most words whose hashes are remembered in a Python worker.
REMEMBERED = 250_000


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_hashes = Hashes()


def begin() -> None:
    at_work("toxicity", _hashes.clear)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """The hashed places of a text's features, with repeats."""
    words = TOKEN.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    get = _hashes.__getitem__
    w = np.fromiter(map(get, words), np.uint64, len(words))
    odd = np.uint64(0x9E3779B97F4A7C15)
    pair = (w[:-1] * odd) ^ (w[1:] >> np.uint64(7)) ^ w[1:]
    skip = ((w[:-2] ^ np.uint64(0xABCDEF)) * odd + w[2:]) if len(w) > 2 else w[:0]
    return (np.concatenate([w, pair * odd, skip * odd]) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(text: str | None, bits: int = BITS) -> np.ndarray:
    return np.unique(features(text or "", bits)).astype(np.int32)


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float
    trained: bool = True

    def score(self, texts: list[str | None], bits: int = BITS) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        sums = np.full(len(texts), self.bias)
        table = self.__dict__.get("_table")
        if table is None or len(table) != 1 << bits:
            table = self.__dict__["_table"] = np.zeros(1 << bits, np.float32)
            table[self.places] = self.weights
        for i, t in enumerate(texts):
            if t and len(f := features(t, bits)):
                hit = f[table[f] != 0]
                if len(hit):
                    sums[i] += table[np.unique(hit)].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0, epochs: int = 3) -> Model:
    """FTRL-proximal with per-coordinate rates, from distinct places and labels. The order of the rows is the order of the updates."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for f, y in rows:
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            rate = (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha
            z[f], n[f] = zf + g - rate * w, nf + g * g
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias, nb + g * g
    places = np.flatnonzero(np.abs(z) > l1)
    weights = -(z[places] - np.sign(z[places]) * l1) / ((beta + np.sqrt(n[places])) / alpha + l2)
    return Model(places, weights.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)), bool(rows))


def fold(id_col: str, folds: int = 5):
    """The document's fold: crc32 of its id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, held_out: bool = True, bits: int = BITS) -> Model:
    """The model from a sample of labelled documents; with ``held_out``, fold 0 is left alone."""
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    if held_out:
        marked = marked.filter(fold("_id") != 0)
    chosen = marked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    # of repeated ids, one text each: the smallest
    rows = rows.groupBy("_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("_y").alias("y")).withColumn("h", F.xxhash64("_id"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        got = []  # texts are let go batch by batch
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got += ((h, i, distinct(t, bits), int(y > 0)) for h, i, t, y in zip(*(part.column(x).to_pylist() for x in ("h", "_id", "text", "y"))))
        got.sort(key=lambda x: x[:2])
        m = train([x[2:] for x in got], bits)
        yield pa.RecordBatch.from_pydict({"places": [m.places.tolist()], "weights": [m.weights.tolist()], "bias": [m.bias], "trained": [m.trained]}, schema=pa.schema([("places", pa.list_(pa.int64())), ("weights", pa.list_(pa.float32())), ("bias", pa.float64()), ("trained", pa.bool_())]))

    got = rows.repartition(1).mapInArrow(one, "places array<long>, weights array<float>, bias double, trained boolean").collect()
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, False)
    return Model(np.array(got[0]["places"], np.int64), np.array(got[0]["weights"], np.float32), got[0]["bias"], got[0]["trained"])


def score(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS, into: str = "score") -> DataFrame:
    """``docs`` with a column for the score (in place of one of that name, if there is); all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(into) if into in docs.columns else docs
    schema = base.withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column(part.schema.get_field_index(text_col)).to_pylist(), bits))], names=[*part.schema.names, into])

    return base.mapInArrow(run, schema)
