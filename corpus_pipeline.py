"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicates, source mix, packing.

Each stage takes the documents its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.llm.common import SPACES, WORD, packed, stored, table
from arqueo.llm.line_dedup import dedup_lines
from arqueo.llm.mixing import mix
from arqueo.llm.near_dedup import near_duplicates
from arqueo.llm.packing import pack
from arqueo.llm.queries import tokenizer_file
from arqueo.llm.toxicity import score_toxicity


def _row(docs: DataFrame, **own) -> DataFrame:
    """The row as one struct next to what a stage needs: no column of the input meets a name of an operator's."""
    return packed(docs, doc_id=F.col("doc_id"), text=F.col("text").cast("string"), **own)


def _columns(judged: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs``, some with new values."""
    return judged.select(*[(changed[c].cast(t) if c in changed else F.col("row").getField(c)).alias(c) for c, t in docs.dtypes])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go.

    Null and empty texts stay unless the model finds empty texts toxic; repeated rows share their verdict; rows
    with a null id are judged like others.
    """
    judged = score_toxicity(_row(docs), table(spark, sf_dir, "labels"))
    return _columns(judged.filter("predicted = 0"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them; n_chars follows the text.

    Every row stays, at worst with an empty text; a null text becomes the empty one. Rows that
    repeat an id share its lines. Null ids count as one document after all others.
    """
    return _columns(dedup_lines(_row(docs)), docs, text=F.col("kept_text"), n_chars=F.length("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8).

    Texts without words are linked with nothing, so all of them stay. Of repeated rows those with
    the kept id stay, as they are one document.
    """
    return _columns(near_duplicates(_row(docs)).filter("kept"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: whole copies of a document, then its first words if the mix ends inside it.

    At most one document of a source is cut; its n_chars follows. A document that the
    mix does not take, or that has no words, goes. Rows that repeat id and text are taken alike,
    each to the mean of them, rounded up.
    """
    # a text is known by its id and hash: only those are carried along the line
    known = docs.select("doc_id", "source", F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    taken = mix(known).filter("taken > 0").groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("h")).agg(
        F.ceil(F.avg("taken")).alias("taken"), F.max("size").alias("size")
    )
    rows = _row(docs, hash=F.xxhash64(F.col("text").cast("string")))
    met = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")))
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = met.withColumns({"whole": whole, "rest": rest}).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("whole") + F.signum("rest").cast("int"))))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"{SPACES[:-1]}*{WORD}"), F.lit(0)), 1, F.col("rest").cast("int")), "")
    cut = copies.withColumn("cut", F.when(F.col("nth") > F.col("whole"), head))
    n_chars = F.coalesce(F.length("cut"), F.col("row").getField("n_chars")) if "n_chars" in docs.columns else F.lit(None)
    return _columns(cut, docs, text=F.coalesce("cut", "text"), n_chars=n_chars)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 tokens; every row is packed, also empty and repeated ones."""
    return pack(docs.select("doc_id", "text"), tokenizer_file())


STAGES = [
    ("toxicity", toxicity), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("source mix", source_mix), ("packing", packing),
]

# compression lengths and token ids are beyond SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
