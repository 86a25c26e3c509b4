"""Line dedup: lines that many documents share stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import SPACE_CHARS, lower_ascii, packed, stored, unpacked

LAST_ID = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines
    except those of the smallest doc_id that holds the key.

    Lines are exploded to two 64-bit hashes, document and position; texts are not shuffled with
    them. Hashes are counted with partial aggregation, so a line that a third of all documents
    hold is one row per task, and the join back to the lines is one that adaptive execution can
    split. Documents meet their dropped positions in one join and are put together again by
    position.

    Null or empty text is one empty line, and an empty table gives an empty result. Rows with a
    null doc_id count together as one document, after all others. Repeated rows (same id and
    text) get the same result. Lines repeated inside the document that keeps them stay.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ident = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    exploded = docs.select(
        ident.alias("ident"), text_hash.alias("text_hash"),
        F.posexplode(F.split(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), "\n", -1)).alias("pos", "line"),
    ).withColumn("line", F.btrim("line", F.lit(SPACE_CHARS)))
    lines = stored(
        exploded.filter(F.length("line") >= min_chars).select(
            F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "ident", "text_hash", "pos"
        ), "lines",
    )
    shared = lines.groupBy("h1", "h2").agg(
        F.count_distinct("ident").alias("n_docs"), F.min("ident").alias("first")
    ).filter(F.col("n_docs") >= min_docs).drop("n_docs")
    dropped = (
        lines.join(shared, ["h1", "h2"]).filter("ident != first")
        .groupBy("ident", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    )
    whole = packed(docs, ident=ident, text_hash=text_hash).join(dropped, ["ident", "text_hash"], "left").withColumns({
        "lines": _lines(F.col("row.text")),
        "dropped": F.coalesce("dropped", F.array().cast("array<int>")),
    })
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.size("dropped") == 0, F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return unpacked(
        whole, kept_text=kept, n_lines=F.size("lines").cast("bigint"), n_dropped=F.size("dropped").cast("bigint")
    )
