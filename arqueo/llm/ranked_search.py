"""Ranked lexical search: the best-position algorithm over shards of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import packed, stored, unpacked
from arqueo.operators.ranking import spread_row_number

# --- Fixed values: all ASCII characters but digits and letters part terms; A-Z become a-z ---
PARTING = bytes(c for c in range(128) if not chr(c).isalnum())
TO_TERMS = bytes.maketrans(PARTING + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(PARTING) + b"abcdefghijklmnopqrstuvwxyz")
# --- end of fixed values ---
ITEMS = 512  # items of one pass over the documents
CELLS = 24_000_000  # (term, document) places of one shard in a task's memory
FIRST_READ = 32  # positions every list is read to before the first test whether to stop
LONG = 2**63 - 1


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; they do not depend on its encoding, as only ASCII parts or changes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TO_TERMS).split()


def term_weight(documents: int, holding: int) -> int:
    """floor(1000 ln((2N + 2) / (2df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"nth": batch.column("nth"), "terms": pa.array(terms, pa.list_(pa.binary()))})


def _postings(vocabulary: dict[bytes, int]):
    """Per document: how many terms it has, and which of the vocabulary's, with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            sizes, bounds, terms, counts = [], [0], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = Counter(w for w in words if w in known)
                sizes.append(len(words))
                terms.extend(vocabulary[w] for w in found)
                counts.extend(found.values())
                bounds.append(len(terms))
            offsets = pa.array(bounds, pa.int32())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "size": pa.array(sizes, pa.int64()),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            })

    return run


class Shard:
    """Impact lists of some documents: per term the documents by falling impact, and every document's place there."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.ids = ids
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        lengths = np.bincount(terms, minlength=vocabulary)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.place = np.full((vocabulary, len(ids)), -1, dtype=np.int32)
        self.place[terms[order], self.docs] = np.arange(len(order)) - self.starts[terms[order]]

    def best(self, terms: np.ndarray, k: int, known: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
        """The k best of these documents and the ``known`` (-score, place of id) ones; and how many documents were scored.

        All lists are read to the same depth, which doubles. A document met for the first time
        is looked up in every list, which gives its score and marks its places as seen. The best
        position of a list is the last before which no place is unseen: an unseen document
        has at most the impact at that position in each list. Reading stops when the sum of
        these is strictly below the k-th score, so equal scores are all met.
        """
        terms = terms[self.ends[terms] > self.starts[terms]]
        starts, lengths = self.starts[terms], self.ends[terms] - self.starts[terms]
        seen_at = np.concatenate([[0], np.cumsum(lengths)])
        seen = np.zeros(seen_at[-1], dtype=bool)
        met = np.zeros(len(self.ids), dtype=bool)
        position, best, depth, scored = np.zeros(len(terms), dtype=np.int64), known, 0, 0
        while len(terms) and (position < lengths).any():
            reach = depth * 2 or FIRST_READ
            read = np.concatenate([self.docs[s + depth:s + min(reach, n)] for s, n in zip(starts, lengths)])
            depth, fresh = reach, np.unique(read[~met[read]])
            met[fresh] = True
            scored += len(fresh)
            # direct accesses: all places of the new documents
            place = self.place[np.ix_(terms, fresh)]
            there = place >= 0
            impact = np.where(there, self.impacts[np.where(there, starts[:, None] + place, 0)], 0)
            seen[(seen_at[:-1, None] + place)[there]] = True
            scores = impact.sum(axis=0)
            if len(best) >= k:
                # worse ones cannot come in; equal ones can, by their id
                keep = scores >= -best[-1][0]
                fresh, scores = fresh[keep], scores[keep]
            found = [(-int(s), i) for s, i in zip(scores, self.ids[fresh]) if s > 0]
            if found:
                best = sorted(best + found)[:k]
            bound = 0
            for i, (at, n) in enumerate(zip(seen_at, lengths)):
                tail = seen[at + position[i]:at + n]
                gap = tail.argmin() if len(tail) else 0
                position[i] += len(tail) if len(tail) and tail[gap] else gap
                # no unseen document is left in a list that was seen to its end
                bound += int(self.impacts[starts[i] + position[i] - 1]) if 0 < position[i] < n else 0
            if len(best) == k and bound < -best[-1][0]:
                break
        return best, scored


def _search(weights: np.ndarray, items: list[tuple[int, np.ndarray]], documents: int, all_terms: int, k: int, cells: int):
    """Per task: shards of bounded size one after another, each starting from the best of those before."""
    vocabulary = len(weights)
    rows = max(1, cells // max(1, vocabulary))

    def impacts(size: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        most = int(size.max(initial=0))
        exact = size if 90 * most * documents <= LONG else size.astype(object)
        measure = (10 + (90 * exact * documents) // max(1, all_terms)).astype(np.int64)
        return weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * measure[docs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {nth: [] for nth, _ in items}
        scored = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("terms")
                offsets = lists.offsets.to_numpy()
                terms = lists.values.to_numpy()[offsets[0]:offsets[-1]]
                counts = part.column("counts").values.to_numpy()[offsets[0]:offsets[-1]]
                docs = np.repeat(np.arange(part.num_rows), np.diff(offsets)).astype(np.int32)
                # ids as Python numbers, null last
                ids = np.empty(part.num_rows, dtype=object)
                ids[:] = [(i is None, i or 0) for i in part.column("doc_id").to_pylist()]
                size = part.column("size").to_numpy()
                shard = Shard(ids, terms, docs, impacts(size, terms, counts, docs), vocabulary)
                for nth, own in items:
                    best[nth], n = shard.best(own, k, best[nth])
                    scored += n
        out = [(nth, None if i[0] else i[1], -s, scored) for nth, found in best.items() for s, i in found]
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("nth", "doc_id", "score", "scored"), columns)})

    return run


def _by_rank(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item over all tasks: each task sends k at most, so an item has few rows."""
    place = Window.partitionBy("nth").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, items_at_once: int = ITEMS, cells: int = CELLS) -> DataFrame:
    """The ``k`` best documents of every item: the columns of ``items``, then rank, doc_id and score.

    ``docs`` has doc_id and text, ``items`` has text. Terms are runs of ASCII letters and digits
    and of all other characters, in whole texts, with A-Z in lower case. Scores are whole numbers:
    the sum over the item's distinct terms of weight and saturated frequency. Documents with
    score 0 are not returned; equal scores go by ascending doc_id, a null id last.

    Every document is tokenised once for a block of ``items_at_once`` items, which any number of
    items is dealt into; only the frequencies of the block's terms are kept. N, L and df are
    counted on Spark over all documents. Tasks then hold shards of their documents as impact
    lists, ``cells`` (term, document) places at a time, and run the best-position algorithm for
    each item, so a task's memory does not grow with texts or documents. Only the best k of each task and
    item are shuffled.

    Null or empty texts have no terms: as documents they are not counted, as items they find
    nothing. Repeated documents are ranked as documents of their own, repeated items are answered
    one by one; an empty table on either side gives an empty result. Columns of ``items`` called
    rank, doc_id or score are replaced; other columns of ``docs`` are ignored.
    """
    rows = packed(items, text=F.col("text").cast("string"))
    numbered = stored(spread_row_number(rows, [], [F.col("text").asc()], "nth"), "items")
    terms = stored(numbered.select("nth", "text").mapInArrow(_item_terms, "nth bigint, terms array<binary>"), "item_terms")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for first in range(0, numbered.count(), items_at_once):
        block = terms.filter(F.col("nth").between(first + 1, first + items_at_once)).collect()
        some = _search_block(source, [(r["nth"], r["terms"]) for r in block], k, cells)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "nth bigint, doc_id bigint, score bigint, rank int")
    answered = numbered.select("nth", "row").join(found.select("nth", "doc_id", "score", "rank"), "nth")
    return unpacked(answered, rank=F.col("rank"), doc_id=F.col("doc_id"), score=F.col("score"))


def _search_block(source: DataFrame, block: list[tuple[int, list[bytes]]], k: int, cells: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for _, found in block for t in found}))}
    postings = stored(source.mapInArrow(
        _postings(vocabulary), "doc_id bigint, size bigint, terms array<int>, counts array<bigint>"
    ), "postings")
    documents, all_terms = postings.agg(F.count(F.when(F.col("size") > 0, 1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    # one number per term of the block
    holding = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([term_weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    items = [(nth, np.array([vocabulary[bytes(t)] for t in found], dtype=np.int64)) for nth, found in block]
    best = postings.filter(F.size("terms") > 0).mapInArrow(
        _search(weights, items, documents, all_terms, k, cells), "nth bigint, doc_id bigint, score bigint, scored bigint"
    )
    return _by_rank(best, k)
