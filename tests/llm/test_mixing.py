import hashlib
import re

from pyspark.sql import functions as F

import arqueo.llm.mixing as mixing
from arqueo.llm.mixing import golden_point, mix, plan_mix, source_targets
from tests.llm.cases import SF, documents, empty, odd

BLOCK = mixing.BLOCK_WORDS
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, targets):
    """{doc_id: words taken} of (doc_id, source, text) rows with distinct ids, slot by slot."""
    sizes = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total, ends, at = sum(targets[s] for s in order), [], 0.0
    for s in order:
        at += targets[s]
        ends.append(at / total)
    ends[-1] = 1.0
    lines = {s: sorted((i for i, o, _ in rows if o == s), key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest()) for s in order}
    slots = dict.fromkeys(order, 0)
    for n in range(1, -(-sum(sizes.values()) // BLOCK) + 1):
        x = n * mixing.GOLDEN_32 % 2**32 / 2**32
        slots[order[next(k for k, e in enumerate(ends) if x < e)]] += 1
    taken = dict.fromkeys(sizes, 0)
    for s in order:
        size = sum(sizes[i] for i in lines[s])
        left = min(max(slots[s], targets[s] > 0) * BLOCK, 3 * size)
        while left:
            for i in lines[s]:
                n = min(left, sizes[i])
                taken[i], left = taken[i] + n, left - n
    return taken


def targets_of(spark, rows):
    sized = spark.createDataFrame([(s, len(WORD.findall(t or ""))) for _, s, t in rows], "source string, size bigint")
    return {r.source: r.target for r in source_targets(sized, (1, 2, 3), 3).collect()}


def test_odd_rows(spark):
    out = mix(odd(spark))
    rows = out.collect()
    assert len(rows) == 16 and "text" not in out.columns and "odd.name" in out.columns
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * BLOCK


def test_targets_stop_at_three_times_the_source(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1), ("c", 0), ("d", 5)], "source string, size bigint")
    got = {r.source: r.target for r in source_targets(sized, (1, 2, 3), 3).collect()}
    assert got["a"] == 30 and got[None] == 3 and got["c"] == 0 and got["d"] == 15
    assert abs(sum(got.values()) - 1016) < 1e-9 and abs(got["b"] - 968) < 1e-9


def test_every_source_takes_its_target_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, again = (sorted(map(tuple, mix(d).select("doc_id", "size", "target", "taken").collect())) for d in (docs, docs.repartition(5)))
    assert first == again
    per = mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 * BLOCK for r in per)


def test_slots_by_hand(spark):
    rows = [tuple(r) for r in documents(spark)[["doc_id", "source", "text"]].itertuples(index=False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id: r.taken for r in mix(docs).select("doc_id", "taken").collect()}
    assert got == by_hand(rows, targets_of(spark, rows))


def test_the_schedule_decides(spark, monkeypatch):
    """With points that all fall into one place, one source would get all slots."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.taken for r in mix(docs).collect()}
    monkeypatch.setattr(mixing, "golden_point", lambda n: F.lit(0.999) + 0 * n)
    assert {r.doc_id: r.taken for r in mix(docs).collect()} != before


def test_every_stretch_of_slots_meets_the_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = plan_mix(docs)
    pieces = plan.order().collect()
    targets = {r.source: r.target for r in plan.sources.collect()}
    total, last = sum(targets.values()), max(r.slot for r in pieces)
    for start in range(0, last - 1000, 700):
        inside = [r for r in pieces if start < r.slot <= start + 1000]
        words = {s: sum(r.to_word - r.from_word for r in inside if r.source == s) for s in targets}
        assert all(abs(words[s] / sum(words.values()) - targets[s] / total) < 0.01 for s in targets)
    summed = {}
    for r in pieces:
        summed[r.doc_id] = summed.get(r.doc_id, 0) + r.to_word - r.from_word
    assert summed == {r.doc_id: r.taken for r in mix(docs).filter("taken > 0").collect()}


def test_points_are_even(spark):
    cells = spark.range(1, 4097).groupBy((golden_point(F.col("id")) * 16).cast("int").alias("cell")).count().collect()
    assert len(cells) == 16 and all(abs(r["count"] - 256) <= 2 for r in cells)


def test_empty(spark):
    assert mix(empty(spark)).count() == 0
