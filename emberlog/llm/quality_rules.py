"""Cross-document line frequency, over simple rules for a text of its own.

A text is split at \\n. A line's key is the 64-bit hash of its host and its normalised form (A-Z in lower case, ASCII
white space runs as one space, none at the ends); lines without a word have none. A key's frequency is the number of
distinct documents with it; rows of the same id are one document. Lines above ``max_docs`` are removed; a document that
loses more than ``max_lost`` percent of its words so is depleted and rejected. So a page in many copies is rejected as
boiler plate; give ``texts=True`` to count exact copies of a text once instead.

Counting is a plain grouped count first, which bounds the distinct count from above; only keys above the limit by that
are counted exactly, by (key, document) first. No group is ever collected, and a hot host or line is only a row in
partial sums. Where lines meet the keys above the limit, a hot line would fill a task: keys with more than a
``HOT``-th of all lines are at most ``HOT``, and so are broadcast; each of the others has less than that in its task.

Defined results: null and empty texts have no words and fail the base rules; a null host is a host of its own; rows
without an id are documents each for itself; repeated rows are judged each for itself, and none of them raises a
frequency; an empty table gives an empty one. Whole texts are read, other columns are not.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, signed, spool

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: A line is hot where more than this part of all lines has its key.
HOT = 4096

BASE = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64())] + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash")] + [("line_keys", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])
FIELDS = "doc_id long, rid long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, line_keys array<long>, line_words array<int>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) < 1 << 20:
        keys = pairs[:-1] * len(ids) + a[2:]
    else:
        keys = np.unique(pairs, return_inverse=True)[1][:-1] * len(ids) + a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def measure(rows: dict[str, list]) -> dict[str, list]:
    """The base figures of each text and the keys of its lines."""
    made: dict[str, list] = {x: [] for x in BASE.names}
    for key, rid, host, text in zip(rows["doc_id"], rows["rid"], rows["host"], rows["text"]):
        text = text or ""
        data, words, seen, dup, lines = text.encode(), [], set(), 0, Counter()
        start = xxhash.xxh64(b"\1" if host is None else b"\0" + host.encode() + b"\0")
        for line in data.split(b"\n"):
            if own := line.split():
                words += own
                dup += line in seen
                seen.add(line)
                h = start.copy()
                h.update(b" ".join(own).lower())
                lines[signed(h.intdigest())] += len(own)
        for name, value in (("doc_id", key), ("rid", rid), ("n_words", len(words)), ("word_chars", len(text) - sum(map(text.count, BLANKS))), ("n_symbols", sum(map(text.count, SYMBOLS))), ("n_dup_lines", dup), ("n_repeat_words", repeated_words(words)), ("text_hash", signed(xxhash.xxh64_intdigest(data))), ("line_keys", list(lines)), ("line_words", list(lines.values()))):
            made[name].append(value)
    return made


def _lines(base: DataFrame, texts: bool) -> DataFrame:
    """rid, key, words, and the document that counts: its id (or text), or the row where it has none."""
    who = [F.col("text_hash").alias("who"), F.lit(None).cast("long").alias("alone")] if texts else [F.col("doc_id").alias("who"), F.when(F.col("doc_id").isNull(), F.col("rid")).alias("alone")]
    line = F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")
    return base.select("rid", *who, line).select("rid", "who", "alone", F.col("x.line_keys").alias("key"), F.col("x.line_words").alias("words"))


def frequent_lines(base: DataFrame, max_docs: int, texts: bool = False) -> DataFrame:
    """rid, key, words of the lines whose key more than ``max_docs`` documents have."""
    lines = _lines(base, texts)
    counts = spool(lines.groupBy("key").count().filter(F.col("count") > max_docs))
    total = base.agg(F.sum(F.size("line_keys"))).first()[0] or 0
    is_hot = F.col("count") * HOT > total  # so at most HOT keys are
    hot, other = F.broadcast(counts.filter(is_hot).select("key")), counts.filter(~is_hot).select("key")
    found = lines.join(hot, "key").withColumn("hot", F.lit(True)).union(lines.join(hot, "key", "left_anti").select("key", "rid", "who", "alone", "words").join(other, "key").withColumn("hot", F.lit(False)))
    found = spool(found)
    above = spool(found.select("key", "hot", "who", "alone").distinct().groupBy("key", "hot").count().filter(F.col("count") > max_docs))
    few, many = F.broadcast(above.filter("hot").select("key")), above.filter("NOT hot").select("key")
    return found.filter("hot").join(few, "key").union(found.filter("NOT hot").join(many, "key")).select("rid", "key", "words")


def line_frequency(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = 20, max_lost: int = 50, texts: bool = False) -> DataFrame:
    """A row per document: base figures, words on removed lines, and the verdict of the method."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    base = spool(rows.mapInArrow(by_slices(measure, BASE), FIELDS))
    lost = frequent_lines(base, max_docs, texts).groupBy("rid").agg(F.sum("words").alias("removed_words"))
    out = base.drop("line_keys", "line_words", "text_hash").join(lost, "rid", "left")
    removed = F.coalesce("removed_words", F.lit(0))
    return out.withColumn("removed_words", removed).withColumn("depleted", 100 * F.col("removed_words") > max_lost * F.col("n_words"))


def _rewritten(text: str | None, host: str | None, drop: list[int] | None, max_lost: int) -> tuple[str | None, bool]:
    """A text without the lines of the keys, and whether it stays."""
    if not drop or text is None:
        return text, True
    start = xxhash.xxh64(b"\1" if host is None else b"\0" + host.encode() + b"\0")
    gone, total, left, keys = 0, 0, [], set(drop)
    for line in text.split("\n"):
        own = line.encode().split()
        h = start.copy()
        h.update(b" ".join(own).lower())
        total += len(own)
        if own and signed(h.intdigest()) in keys:
            gone += len(own)
        else:
            left.append(line)
    return "\n".join(left), 100 * gone <= max_lost * total


def remove_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = 20, max_lost: int = 50, texts: bool = False) -> DataFrame:
    """``docs`` without the documents that the method rejects and without the lines above the limit in the others; columns as before."""
    own = docs.columns
    # names that clash with none of the columns
    rid, host, drop = (next(x for n in range(len(own) + 1) if (x := f"__{name}_{n}") not in own) for name in ("rid", "host", "drop"))
    judged = spool(docs.withColumn(rid, F.monotonically_increasing_id()).withColumn(host, F.col(host_col).cast("string")))
    rows = judged.select(F.col(id_col).cast("long").alias("doc_id"), F.col(rid).alias("rid"), F.col(host).alias("host"), F.col(text_col).alias("text"))
    base = spool(rows.mapInArrow(by_slices(measure, BASE), FIELDS))
    keys = frequent_lines(base, max_docs, texts).groupBy("rid").agg(F.collect_set("key").alias(drop)).select(F.col("rid").alias(rid), drop)
    joined = judged.join(keys, rid, "left").select(*own, host, drop)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, parts = batch.schema.get_field_index(text_col), [batch.slice(at, 256) for at in range(0, batch.num_rows, 256)]
            for part in parts:
                made = [_rewritten(t, h, d, max_lost) for t, h, d in zip(part.column(i).to_pylist(), part.column(host).to_pylist(), part.column(drop).to_pylist())]
                part = part.set_column(i, batch.schema.field(i), pa.array([t for t, _ in made], batch.schema.field(i).type))
                yield part.filter(pa.array([stays for _, stays in made], pa.bool_())).select(own)

    return joined.mapInArrow(rewrite, docs.schema)
