"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import WORD, packed, quoted, stored, unpacked

# --- Fixed value: 2**32 divided by the golden ratio, made odd ---
GOLDEN_32 = 2654435769
# --- end of fixed value ---
CHUNK = 1 << 16  # slots ranked together
PREFIX = 3  # hex digits of the shuffle key: a source is laid out in 4096 parts
CELLS = 4096  # of the unit interval, for the join of points and sources
BLOCK_WORDS = 64  # of a slot


def golden_point(n: Column) -> Column:
    """Fraction of n divided by the golden ratio, in exact integer steps of 2**-32."""
    low = n % 65536
    high = (n / 65536).cast("bigint") % 65536
    return (((high * GOLDEN_32) % 2**32 * 65536 + low * GOLDEN_32) % 2**32) / F.lit(float(2**32))


def source_targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(nth, source, source_size, target, lo, hi): one row per source in code point order, null last.

    Targets share the total by weight; those above ``cap`` times their source's size stop there
    and the excess is shared again. That ends at target = min(cap, level * weight): sources are
    sorted by cap / weight, and the level is the first at which the source itself is not full.
    """
    everything = Window.partitionBy()
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full_first = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_source.withColumn("nth", F.row_number().over(order) - 1).withColumns({
        "weight": F.get(F.array(*[F.lit(w) for w in weights]), F.col("nth") % len(weights)).cast("bigint"),
        "limit": F.col("source_size") * cap,
        "total": F.sum("source_size").over(everything),
    })
    levelled = ranked.withColumn("all_weight", F.sum("weight").over(everything)).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    # the first row, in this order, that its level does not fill
    reached = F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), "nth", "level"))).over(everything)
    target = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("limit").cast("double"), F.coalesce(reached["level"], F.col("level")) * F.col("weight"))
    )
    to_here = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    shared = levelled.withColumn("target", target).withColumn("sum", F.sum("target").over(everything))
    return shared.withColumn("hi", F.sum("target").over(to_here) / F.col("sum")).select(
        "nth", "source", "source_size", "target",
        F.coalesce(F.lag("hi").over(Window.orderBy("nth")), F.lit(0.0)).alias("lo"),
        F.when(F.row_number().over(Window.orderBy(F.col("nth").desc())) == 1, F.lit(1.0)).otherwise(F.col("hi")).alias("hi"),
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, nth, rank): which source fills each of ``slots`` slots, ranked per source in the order of slots.

    Points are mapped through the cumulative weights by an equi-join on cells of the unit
    interval. Ranks are counted in chunks of slots, so a source that fills most of them is
    not ranked by one task. A source with a target that no point meets gets one slot after all others.
    """
    spark = targets.sparkSession
    cells = targets.filter("hi > lo").select(
        "nth", "lo", "hi",
        F.explode(F.sequence((F.col("lo") * CELLS).cast("int"), F.least((F.col("hi") * CELLS).cast("int"), F.lit(CELLS - 1)))).alias("cell"),
    )
    points = spark.range(1, slots + 1).withColumn("x", golden_point(F.col("id"))).withColumn("cell", (F.col("x") * CELLS).cast("int"))
    placed = points.join(cells, "cell").filter("x >= lo and x < hi").select(
        "id", "nth", (F.col("id") / CHUNK).cast("bigint").alias("chunk")
    )
    before = Window.partitionBy("nth").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("nth", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "nth", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    local = F.row_number().over(Window.partitionBy("nth", "chunk").orderBy("id")) - 1
    ranked = placed.withColumn("local", local).join(offsets, ["nth", "chunk"]).select(
        F.col("id").alias("slot"), "nth", (F.col("local") + F.col("earlier")).cast("bigint").alias("rank")
    )
    unmet = targets.filter("target > 0").join(placed.select("nth").distinct(), "nth", "left_anti")
    return ranked.unionByName(unmet.select((F.lit(slots + 1) + F.col("nth")).cast("bigint").alias("slot"), "nth", F.lit(0).cast("bigint").alias("rank")))


@dataclass(frozen=True)
class Mix:
    """The parts of a mix: every row on its source's line, and the pieces of the line that the slots take."""

    line: DataFrame  # row, nth, source_size, target, size, start
    pieces: DataFrame  # slot, nth, start, from_word, to_word: whole words of the row that starts there
    sources: DataFrame  # nth, source, source_size, target

    def order(self) -> DataFrame:
        """(slot, source, doc_id, from_word, to_word): what to read, in the order of slots.

        Every stretch of slots has the sources in nearly the proportion of their targets.
        """
        rows = self.line.filter("size > 0").select("nth", "start", "doc_id")
        named = self.sources.select("nth", "source")
        return self.pieces.join(rows, ["nth", "start"]).join(F.broadcast(named) if named.count() <= CELLS else named, "nth").select(
            "slot", "source", "doc_id", "from_word", "to_word"
        )


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0,
) -> Mix:
    """The schedule of slots, met with the documents of each source.

    Documents of a source are laid end to end in a shuffled order (md5 of id and seed; of the text
    where the id is null). There is a slot for every ``block_words`` words of all documents, filled by the source
    whose stretch of the cumulative targets its point falls into. The r-th slot of a source takes
    the r-th block of ``block_words`` words from the source's line, which starts again when it ends, up to
    ``cap`` times. So a source gets words in proportion to its slots.

    Starts on the line come from sums per (source, md5 prefix), so no source is sorted by one
    task. Blocks and documents meet by an equi-join on cells of the line.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    key = F.md5(F.concat_ws(":", name, F.lit(str(seed))))
    sized = stored(packed(docs.select(*[quoted(c) for c in docs.columns if c.lower() != "text"], words.alias("__words"), key.alias("__key")),
                          source=F.col("source"), doc_id=F.col("doc_id"), size=F.col("__words"), key=F.col("__key")), "sized")
    targets = stored(source_targets(sized, weights, cap), "targets")
    total = sized.agg(F.sum("size")).first()[0] or 0
    slots = -(-total // block_words)

    numbered = sized.join(targets.select("nth", F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    bucket = F.substring("key", 1, PREFIX)
    earlier = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = numbered.groupBy("nth", bucket.alias("bucket")).agg(F.sum("size").alias("n")).select(
        "nth", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("nth", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = numbered.withColumn("bucket", bucket).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        buckets, ["nth", "bucket"]
    ).withColumn("start", F.col("ahead") + F.col("inner"))

    block = schedule(targets, slots).join(targets.select("nth", "source_size"), "nth").select(
        "slot", "nth", "source_size", (F.col("rank") * block_words).alias("a"),
        F.least((F.col("rank") + 1) * block_words, F.col("source_size") * cap).alias("b"),
    ).filter("b > a")
    turn = F.col("turn") * F.col("source_size")
    cell_words = 16 * block_words
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell_words), F.floor((hi - 1) / cell_words))
    blocks = block.select(
        "*", F.explode(F.sequence(F.floor(F.col("a") / F.col("source_size")), F.floor((F.col("b") - 1) / F.col("source_size")))).alias("turn")
    ).select("slot", "nth", (F.greatest("a", turn) - turn).alias("lo"), (F.least(F.col("b"), turn + F.col("source_size")) - turn).alias("hi"))
    blocks = blocks.select("slot", "nth", "lo", "hi", F.explode(cells(F.col("lo"), F.col("hi"))).alias("cell"))
    end = F.col("start") + F.col("size")
    # a document of size 0 shares its start with the next one, but takes nothing
    spread = line.select(
        "nth", "start", "size",
        F.explode(F.when(F.col("size") > 0, cells(F.col("start"), end)).otherwise(F.array().cast("array<bigint>"))).alias("cell"),
    )
    low = F.greatest("lo", "start", F.col("cell") * cell_words)
    high = F.least(F.col("hi"), end, (F.col("cell") + 1) * cell_words)
    pieces = spread.join(blocks, ["nth", "cell"]).select(
        "slot", "nth", "start", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word")
    ).filter("to_word > from_word")
    return Mix(line, pieces, targets)


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken: the words of each document that the slots of ``plan_mix`` take.

    A source takes ``block_words`` words for each of its slots, so within a few blocks of its target.

    Null text has size 0; documents of size 0 take nothing. A null source is a source of its
    own, last in order. Repeated rows follow each other on the line, so each has its own part.
    An empty table gives an empty result. Null ids are laid out by their texts.
    """
    plan = plan_mix(docs, weights, cap, block_words, seed)
    taken = plan.pieces.groupBy("nth", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    mixed = plan.line.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(
        taken.withColumnRenamed("start", "at"), ["nth", "at"], "left"
    )
    result = unpacked(
        mixed, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"),
        taken=F.coalesce(F.col("words"), F.lit(0)).cast("bigint"),
    )
    return result.drop("__words", "__key")
