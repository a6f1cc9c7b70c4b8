"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share the size of all documents; none
gets more than ``cap`` times its own size, and the excess is shared again by weight until none is above. That is
min(cap * size, level * weight) with one level, found from running sums over the sources in order of cap * size / weight.

A document is to be taken x = target / source size times, which is rounded. Blocks of about ``block`` documents of a
source are folded: each document, the largest first, is paired with the pool of those that come after it in the block.
Mass (size times x) moves between the two, one way or the other with the probabilities that keep each one's expectation,
until the document's x is integral, or the pool is at an end: all of its documents are taken 0 or ``cap`` times. What a
pool gains or loses is shared by its documents in proportion to the room that they have. The mass of a block stays as it
is. A block leaves at most one fraction, as a rule of its smallest document; these residuals form the next level's
blocks, down to one residual per source, which is rounded to the nearer integer. So a source misses its target by at
most half of one document, and hardly at all where its smallest documents are small, however large the others are. A hot
source only has more blocks. Randomness is a hash of the documents' keys, so reruns agree.

Defined results: null and empty texts have size 0 and are taken 0 times; repeated rows are numbered and rounded each for
itself; null ids and sources are values like others; an empty table gives an empty one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running, spool

ITEM = "struct<o:bigint,h:bigint,id:bigint,r:bigint,s:bigint,x:double>"

#: This near to an integer is integral.
EDGE = 1e-9

#: The fold of a block: ``items`` (ITEM, the largest first), with x after it. A document's x in the pool is a * x + b by
#: now; sz and ms are the size and the first mass of the pool, m is its mass by now. The pool gives the document ``up``,
#: or gets ``down`` from it.
FOLD = f"""
aggregate(items, aggregate(items, named_struct('a', 1D, 'b', 0D, 'sz', 0L, 'ms', 0D, 'd', cast(array() as array<{ITEM}>)), (z, x) -> named_struct('a', 1D, 'b', 0D, 'sz', z.sz + x.s, 'ms', z.ms + x.x * x.s, 'd', z.d)), (acc, x) ->
 transform(transform(transform(
  array(named_struct('x', least(cast(cap as double), greatest(0D, acc.a * x.x + acc.b)), 'sz', acc.sz - x.s, 'ms', acc.ms - x.x * x.s)),
  t -> named_struct('x', t.x, 'w', floor(t.x + {EDGE}D), 'sz', t.sz, 'ms', t.ms, 'm', least(cast(cap * t.sz as double), greatest(0D, acc.a * t.ms + acc.b * t.sz)))),
  t -> named_struct('x', t.x, 'w', t.w, 'sz', t.sz, 'ms', t.ms, 'm', t.m, 'room', cap * t.sz - t.m, 'up', least((t.w + 1 - t.x) * x.s, t.m), 'down', least((t.x - t.w) * x.s, cap * t.sz - t.m),
   'u', pmod(xxhash64(x.h, x.id, x.r, x.s, seed), 9007199254740992L) / 9007199254740992D)),
  t -> CASE
   WHEN t.x - t.w <= {EDGE}D OR t.up + t.down <= 0D THEN named_struct('a', acc.a, 'b', acc.b, 'sz', t.sz, 'ms', t.ms, 'd', concat(acc.d, array(named_struct('o', x.o, 'h', x.h, 'id', x.id, 'r', x.r, 's', x.s, 'x', t.x))))
   WHEN t.u * (t.up + t.down) < t.down THEN named_struct('a', acc.a * (1D - t.up / t.m), 'b', acc.b * (1D - t.up / t.m), 'sz', t.sz, 'ms', t.ms,
    'd', concat(acc.d, array(named_struct('o', x.o, 'h', x.h, 'id', x.id, 'r', x.r, 's', x.s, 'x', IF(t.up < t.m, t.w + 1D, t.x + t.up / x.s)))))
   ELSE named_struct('a', acc.a * (1D - t.down / t.room), 'b', IF(t.down < t.room, acc.b + t.down / t.room * (cap - acc.b), cast(cap as double)), 'sz', t.sz, 'ms', t.ms,
    'd', concat(acc.d, array(named_struct('o', x.o, 'h', x.h, 'id', x.id, 'r', x.r, 's', x.s, 'x', IF(t.down < t.room, cast(t.w as double), t.x - t.down / x.s))))) END)[0],
 acc -> acc.d)
"""
SETTLED = f"abs(item.x - round(item.x)) <= {EDGE}D"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """src, source_size, n (documents with words), target; one row per source. units: src, size, copies."""
    sums = units.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("n"))
    ranked = running(sums, [F.col("src").asc_nulls_last()]).withColumnRenamed("place", "rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = running(ranked, [F.col("source_size") / F.col("weight"), F.col("rank").asc()], size_before="source_size", weight_before="weight")
    every = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(every["size"] or 0) - cap * F.col("size_before")) / (F.lit(every["weight"] or 1) - F.col("weight_before"))
    ranked = spool(ranked.withColumn("level", level))
    # the level of the first source, in order of cap * size / weight, that its cap does not bind
    chosen = ranked.filter(F.col("level") * F.col("weight") <= cap * F.col("source_size")).agg(F.min_by("level", "place")).first()[0]
    return ranked.select("src", "source_size", "n", F.least((cap * F.col("source_size")).cast("double"), F.lit(float(chosen or 0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 128, seed: int = 20) -> DataFrame:
    """A row per document: id, src, size, r (number among equal rows), source_size, target, times (copies to take)."""
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"))
    units = spool(sized.groupBy("id", "src", "size").agg(F.count("*").alias("copies")))
    goals = spool(targets(units, weights, cap))
    most = goals.agg(F.max("n")).first()[0] or 0
    each = units.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    each = each.join(goals, each["src"].eqNullSafe(goals["src"])).drop(goals["src"])
    # nothing of a document without words can be taken
    x = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    item = F.struct((-F.col("size")).alias("o"), F.xxhash64("id", "src", "size", "r", F.lit(seed)).alias("h"), "id", "r", F.col("size").alias("s"), "x")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    first = spool(each.withColumn("x", x).select("src", F.pmod(item["h"], blocks).alias("blk"), item.alias("item")).withColumn("settled", F.expr(SETTLED)))
    done, over, n, depth = [first.filter("settled")], first.filter("NOT settled").drop("settled"), most, 0
    while True:
        folded = over.groupBy("src", "blk").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumns({"seed": F.lit(seed + depth), "cap": F.lit(cap)})
        folded = spool(folded.select("src", "blk", F.explode(F.expr(FOLD)).alias("item")).withColumn("settled", F.expr(SETTLED)))
        done.append(folded.filter("settled"))
        over = folded.filter("NOT settled").drop("settled")
        n, depth = -(-n // block), depth + 1
        if n <= 1:
            break
        over = over.withColumn("blk", F.floor(F.col("blk") / block))
    found = over.select("src", "item")
    for d in done:
        found = found.union(d.select("src", "item"))
    found = found.select("src", "item.id", "item.r", F.col("item.s").alias("size"), F.round("item.x").cast("long").alias("times"))
    sums = goals.select(F.col("src").alias("g_src"), "source_size", "target")
    return found.join(sums, F.col("src").eqNullSafe(F.col("g_src"))).select("id", "src", "size", "r", "source_size", "target", "times")


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it; columns as before."""
    chosen = mix(docs, id_col, source_col, text_col, **how).filter("times > 0")
    # the row goes along as one struct, so that no column of it can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("k_id"), F.col(source_col).cast("string").alias("k_src"), word_count(F.col(text_col)).alias("k_size"), F.xxhash64(F.col(text_col)).alias("k_text"))
    # numbered among rows that agree in id, source and size; the text's hash makes the order the same in every run
    keyed = keyed.withColumn("k_r", F.row_number().over(Window.partitionBy("k_id", "k_src", "k_size").orderBy("k_text")))
    on = F.col("k_id").eqNullSafe(F.col("id")) & F.col("k_src").eqNullSafe(F.col("src")) & (F.col("k_size") == F.col("size")) & (F.col("k_r") == F.col("r"))
    return keyed.join(chosen, on).withColumn("n", F.explode(F.expr("sequence(1, cast(times as int))"))).select("row.*")
