"""Near-duplicate classes by the Jaccard similarity of word shingles, exactly, in size-banded tiles of bitmap signatures.

1. Every text becomes a sorted array of 64-bit shingle hashes; equal sets share a digest and are one vertex from here on.
2. Candidates without loss: sets are banded by size so that a pair at the limit lies in one band or two neighbours. For
   the sizes of such a tile at most H shingles can differ in a linked pair. Hash space is cut into H + 1 + e segments;
   H differences leave at least e + 1 segments alike, so two sets with at most e empty segments agree in one that is not
   empty. A set gives one key for each non-empty segment (sets with more than e empty ones also give keys for those).
   Unlike a single shingle, a segment holds several, so passages that many documents share make no large groups.
   Keys that many sets share (by a sample that only chooses the way, at most ``HOT`` of them) are not gathered: their hubs
   are partial minima, sent to where their sets are.
3. Vertices that meet at a key are tied to the smallest of them, its hub. The members of a hub are a tile: any linked
   pair is together in one. A tile of many members is dealt in blocks, each with the hub: a block joins its own members.
   Members that are joined to the hub by then are joined to each other, whatever their block. Only the loose ones, which
   are not, are compared with all members of the tile in a second pass. So a large group of near copies costs about as
   many rows as it has members, not rows for all pairs of blocks.
4. In a tile, sets are sorted by size; each is compared with those no larger than the limit allows. Bitmaps with a bit
   for each hashed shingle bound the overlap from above: |A and B| <= |A| - bits(A without B), and the same for B. Only pairs
   that pass, and that no earlier link has joined, have their sorted arrays intersected.
5. Links are contracted to components by alternating star steps, all in joins and partial sums.

Classes are exact, but not every link is found: pairs that an earlier link has joined are not tested, so the links of a
class span it, and their number is no count of all linked pairs. Every link between different classes would be found.

Defined results: texts without words (and nulls) have the empty set, are linked with nothing and are components of
their own; texts with fewer words than a shingle have their whole sequence as one; the class id is the smallest id of a
class, nulls aside; repeated rows are alike, so they share a class (rows with the empty set: that of their own id); an
empty table gives an empty one; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, by_slices, release, signed, split_join, spool, unspool

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
#: Most words whose hashes are remembered in a Python worker.
REMEMBERED = 250_000
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_hashes = Hashes()


def begin() -> None:
    at_work("jaccard_join", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles (A-Z in lower case, words by ASCII white space)."""
    words = (text or "").encode().translate(UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(width, len(w))):
        h = _mixed(h + w[k : k + n])
    return np.unique(h)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class Scheme:
    """Size bands and segment counts for a limit in percent."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1, 2]

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            last = self.edges[-1]
            self.edges.append(max(last + 1, (last - 1) * 100 // self.percent + 1))
        low, high = 0, len(self.edges) - 1
        while low < high - 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.edges[mid] <= n else (low, mid)
        return low

    @lru_cache(maxsize=None)
    def tile(self, band: int) -> tuple[int, int, int]:
        """Largest size that can meet a set of the band, segments, empty segments allowed for; 0 segments: equal sets only."""
        while len(self.edges) < band + 2:
            self.band(self.edges[-1])
        least, most = self.edges[band], self.edges[band + 1] - 1
        other = most * 100 // self.percent
        differ = (most + other) * (100 - self.percent) // (100 + self.percent)
        if not differ:
            return other, 0, 0
        empty = (differ + 1) * math.exp(-least / (differ + 1))
        spare = math.ceil(empty + 3 * math.sqrt(empty))
        return other, differ + 1 + spare, spare

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys of a set."""
        n, made = len(s), []
        own = self.band(n)
        for band in (own - 1, own):
            if band < 0:
                continue
            most, m, spare = self.tile(band)
            if not m or n > most:
                continue
            segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            stops = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s))])
            values = sums[stops[1:]] - sums[stops[:-1]]
            k = _mixed(_mixed(values + np.uint64(band + 1)) + np.arange(m, dtype=np.uint64))
            full = stops[1:] > stops[:-1]
            made.append(k[full] if m - int(full.sum()) <= spare else k)
        return np.concatenate(made) if made else np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(s.tobytes()))


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, d (digest; null for the empty set), keys (null where the task has given those of this digest already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        scheme, seen = Scheme(percent), set()

        def part(rows: dict[str, list]) -> pa.RecordBatch:
            ids, ns, ds, keys, at = rows["doc_id"], [], [], [], [0]
            for text in rows["text"]:
                s = shingles(text, width)
                ns.append(len(s))
                ds.append(digest(s) if len(s) else None)
                k = scheme.keys(s) if len(s) and ds[-1] not in seen else np.zeros(0, np.uint64)
                if len(s) and len(seen) < 1 << 20:
                    seen.add(ds[-1])
                keys.append(k)
                at.append(at[-1] + len(k))
            flat = pa.array(np.concatenate(keys).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], schema=SETS)

        yield from by_slices(part, SETS)(batches)

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n long, d long, keys array<long>")


#: Keys and hubs with more than this part of all rows are hot, so at most this many are.
HOT = 4096
#: One in so many sets is looked at for hot keys, and a hot key must be met so often in them.
LOOK, OFTEN = 256, 16


def _met(keys: DataFrame) -> DataFrame:
    """hub, d: every other set of a key with the key's smallest. keys: d and an array of keys."""
    rows = keys.filter("size(keys) > 0").select(F.explode("keys").alias("key"), "d")
    looked = keys.filter(F.pmod(F.xxhash64("d"), F.lit(LOOK)) == 0)
    total = looked.agg(F.sum(F.greatest(F.size("keys"), F.lit(0)))).first()[0] or 0
    counts = looked.select(F.explode("keys").alias("key")).groupBy("key").count()
    hot = spool(counts.filter((F.col("count") * HOT > total) & (F.col("count") >= OFTEN)).select("key"))
    if hot.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key", "d").mapInArrow(_meetings, "hub long, d long").distinct()
    shared = rows.join(F.broadcast(hot), "key")
    hubs = spool(shared.groupBy("key").agg(F.min("d").alias("hub")))
    often = shared.join(F.broadcast(hubs), "key").filter("hub <> d").select("hub", "d")
    others = rows.join(F.broadcast(hot), "key", "left_anti").select("key", "d")
    return others.repartition("key").sortWithinPartitions("key", "d").mapInArrow(_meetings, "hub long, d long").union(often).distinct()


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, d) sorted by both: ties each other d of a key to the key's smallest."""
    last_key, last_hub = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, d = (batch.column(x).to_numpy() for x in ("key", "d"))
        new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub = np.where(first >= 0, d[first], last_hub)
        last_key, last_hub = key[-1], hub[-1]
        other = hub != d
        pairs = np.unique(np.stack([hub[other], d[other]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "d"])


def tile_links(ds: list[int], sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, joined: np.ndarray | None = None) -> tuple[list[tuple[int, int]], set[int]]:
    """Links that join the members of a tile as all its linked pairs do, and the members that share the first one's group.

    sides: 0 or 1, where only pairs across count. joined: marks members that are known to be in one group.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, d = [sets[i] for i in order], np.array([ds[i] for i in order])
    side = None if sides is None else sides[order]
    size = np.array([len(s) for s in sets])
    n = len(sets)
    width = min(1 << 16, max(64, 1 << int(2 * size[-1]).bit_length())) if n else 64
    bits = np.zeros((n, width // 64), np.uint64)
    for i, s in enumerate(sets):
        place = (s % np.uint64(width)).astype(np.int64)
        np.bitwise_or.at(bits[i], place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    count = np.bitwise_count(bits).sum(1, dtype=np.int64)
    group, links = np.arange(n), []
    if joined is not None and joined.any():
        group[joined[order]] = np.flatnonzero(joined[order])[0]
    for i in range(n):
        stop = np.searchsorted(size, size[i] * 100 // percent, side="right")
        for at in range(i + 1, stop, 2048):
            j = np.arange(at, min(stop, at + 2048))
            j = j[(group[j] != group[i]) & (d[j] != d[i])]
            if side is not None:
                j = j[side[j] != side[i]]
            if not len(j):
                continue
            both = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
            most = np.minimum(size[i] - (count[i] - both), size[j] - (count[j] - both))
            for k in j[100 * most >= percent * (size[i] + size[j] - most)]:
                if group[k] == group[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if linked(common, size[i], size[k], percent):
                    links.append((int(min(d[i], d[k])), int(max(d[i], d[k]))))
                    group[group == group[k]] = group[i]
    return links, set(d[group == group[np.flatnonzero(order == 0)[0]]].tolist())


#: A link (hub is null), or a loose member: the hub, the member as a, and no b.
LINKS = pa.schema([("hub", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
#: What a row is in its tile.
HUB, MEMBER, LOOSE, VISITOR = 0, 1, 2, 3


DEALT = ("hub", "i", "j", "d", "kind", "parts", "s")


def _tiles(percent: int, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (hub, i, j): one tile after the other."""

        def links(tile: list) -> pa.RecordBatch:
            (hub, *_), rows = tile
            rows.sort(key=lambda x: x[2])  # the hub comes first
            ds, sets, kind = [d for d, _, _, _ in rows], [s for _, s, _, _ in rows], np.array([k for _, _, k, _ in rows])
            if second:
                found, loose = [], []
                if kind[-1] == VISITOR:
                    found, _ = tile_links(ds, sets, percent, (kind == VISITOR).astype(np.int8), kind == MEMBER)
            else:
                found, core = tile_links(ds, sets, percent)
                loose = [d for d in ds if d not in core] if rows[0][3] > 1 else []
            none = [None] * len(found)
            return pa.RecordBatch.from_pydict({"hub": none + [hub] * len(loose), "a": [a for a, _ in found] + loose, "b": [b for _, b in found] + [None] * len(loose)}, schema=LINKS)

        tile: list | None = None
        for batch in batches:
            for hub, i, j, d, kind, parts, s in zip(*(batch.column(x).to_pylist() for x in DEALT)):
                if tile is None or tile[0] != (hub, i, j):
                    if tile is not None:
                        yield links(tile)
                    tile = [(hub, i, j), []]
                tile[1].append((d, np.frombuffer(s, np.uint64), kind, parts))
        if tile is not None:
            yield links(tile)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links with the smallest node that it is joined to. Links: a, b."""
    edges = spool(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        old = edges
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = spool(least)  # a table of its own, so that joins on a hot node can be split
        big = edges.select(F.col("v").alias("x"), F.col("u").alias("w")).join(least, F.col("x") == F.col("u")).select(F.col("w").alias("u"), F.col("m").alias("v")).union(
            edges.join(least, "u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        big = spool(big)
        # small star: smaller neighbours and the node itself go to the smallest of them
        low = spool(big.groupBy("u").agg(F.min("v").alias("m")))
        edges = spool(big.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        for done in (old, least, big, low):
            unspool(done)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        state = new


#: Bits of the filter that keeps the texts of other documents from being read again: 1 MB, whatever the corpus.
FILTER_BITS = 1 << 23


def _places(of: str) -> list:
    return [F.pmod(F.xxhash64(F.col(of), F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2)]


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids as 64-bit words. Its size is fixed; a full one lets everything pass, which is slower but right."""
    bits = ids.select(F.explode(F.array(*_places(ids.columns[0]))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def _sets_of(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """d, s (the sorted hashes) of the documents that pass the filter; those without an id do."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        words = shared.value
        for batch in batches:
            a, b = (batch.column(x).to_numpy() for x in ("a", "b"))
            there = np.ones(len(a), bool)
            for bit in (a, b):
                there &= (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            there |= batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            texts = batch.column("text").filter(pa.array(there))
            for at in range(0, len(texts), 256):
                found = [s for s in (shingles(t, width) for t in texts.slice(at, 256).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_pydict({"d": [digest(s) for s in found], "s": [s.tobytes() for s in found]}, schema=pa.schema([("d", pa.int64()), ("s", pa.binary())]))

    a, b = _places("doc_id")
    return docs.select("doc_id", "text", a.alias("a"), b.alias("b")).mapInArrow(run, "d long, s binary")


def _link(rows: DataFrame, sets: DataFrame, percent: int, second: bool = False) -> DataFrame:
    dealt = rows.join(sets, "d").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "d")
    return spool(dealt.select(*DEALT).mapInArrow(_tiles(percent, second), "hub long, a long, b long"))


def _in_part(parts: str) -> "F.Column":
    return F.pmod(F.xxhash64("d"), F.col(parts)).cast("int")


def _every_part(parts: str) -> "F.Column":
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = 64, blocks: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per document, with the smallest id of its class.

    A tile's first pass has blocks of ``block`` members, or ``blocks`` blocks until these hold 8192 members each. In the
    second, ``32 * block`` loose members meet ``32 * block`` members at a time (for tasks of a size, equal shares deal the fewest
    rows).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = spool(_sets(docs, width, percent))
    met = spool(_met(keys))
    own = spool(keys.select("doc_id", "n", "d"))
    unspool(keys)
    release(docs.sparkSession)
    first = own.filter("d IS NOT NULL").groupBy("d").agg(F.min("doc_id").alias("least"))
    # the sets of members, from one text each
    members = met.select("d").union(met.select(F.col("hub").alias("d"))).distinct().join(first, "d")
    sets = _sets_of(docs, _filter_of(members.select("least")), width)
    parts = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(blocks)), F.ceil(F.col("n") / 8192)).cast("int")
    size = spool(met.groupBy("hub").agg((F.count("*") + 1).alias("n")).select("hub", "n", parts.alias("parts")))
    hot = F.col("n") * HOT > met.count()
    hubs = size.withColumn("i", _every_part("parts")).select("hub", "i", F.col("hub").alias("d"), F.lit(HUB).alias("kind"), "parts")
    rows = split_join(met, size, "hub", hot).select("hub", _in_part("parts").alias("i"), "d", F.lit(MEMBER).alias("kind"), "parts").union(hubs)
    first_pass = _link(rows.withColumn("j", F.lit(0)), sets, percent)
    loose = spool(first_pass.filter("hub IS NOT NULL").select("hub", F.col("a").alias("d")).distinct())
    wide = spool(loose.groupBy("hub").agg(F.count("*").alias("m")).join(met.groupBy("hub").agg(F.count("*").alias("n")), "hub").select(
        "hub", "n", F.ceil(F.col("n") / (32 * block)).cast("int").alias("parts"), F.ceil(F.col("m") / (32 * block)).cast("int").alias("visits")))
    links = first_pass
    if not wide.isEmpty():
        members = split_join(met, wide, "hub", hot).join(loose.withColumn("is_loose", F.lit(True)), ["hub", "d"], "left")
        members = members.select("hub", _in_part("parts").alias("i"), _every_part("visits").alias("j"), "d", F.when(F.col("is_loose"), LOOSE).otherwise(MEMBER).alias("kind"), "parts")
        visitors = split_join(loose, wide, "hub", hot).select("hub", _every_part("parts").alias("i"), _in_part("visits").alias("j"), "d", F.lit(VISITOR).alias("kind"), "parts")
        again = members.select("d").distinct().join(first, "d").select("least")
        links = links.union(_link(members.unionByName(visitors), _sets_of(docs, _filter_of(again), width), percent, second=True))
    links = links.filter("hub IS NULL").select("a", "b")
    roots = components(links)
    least = spool(roots.join(first.withColumnRenamed("d", "node"), "node"))
    smallest = spool(least.groupBy("root").agg(F.min("least").alias("component")))
    named = least.join(smallest, "root").select(F.col("node").alias("c_d"), "component")
    named = spool(first.join(named, first["d"] == named["c_d"], "left").select(F.col("d").alias("c_d"), F.coalesce("component", "least").alias("component")))
    return own.join(named, own["d"] == named["c_d"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id (of equal ids, any one); columns as before.

    Classes are those of rows: rows are numbered, so rows without an id are compared like all others (and stay only where
    their class has no row with an id), and rows that share an id by mistake are judged by their texts. Rows without words
    are linked with nothing, so all of them stay.
    """
    rid = next(x for n in range(len(docs.columns) + 1) if (x := f"__rid_{n}") not in docs.columns)
    numbered = spool(docs.withColumn(rid, F.monotonically_increasing_id()))
    found = near_duplicates(numbered.select(F.col(rid).alias("doc_id"), F.col(text_col).alias("text")), width=width, percent=percent)
    ids = numbered.select(F.col(rid).alias("doc_id"), F.col(id_col).cast("long").alias("own"))
    first = F.min(F.struct(F.col("own").isNull(), "own", "doc_id"))["doc_id"]
    kept = found.join(ids, "doc_id").groupBy("component_id").agg(first.alias(rid)).select(rid)
    return numbered.join(kept, rid, "left_semi").select(*docs.columns)
