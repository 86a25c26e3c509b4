"""Quality classifier: ordinal regression with cumulative links over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import bucket_of, packed, unpacked

BUCKETS = 1 << 18
SAMPLE_ROWS = 8000
MEMO = 400_000


def word_shape(word: bytes) -> bytes:
    """Runs of capitals, small letters, digits and other letters as A, a, 0 and x; other characters as they are."""
    out = bytearray()
    for c in word:
        kind = 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 120 if c > 127 else c
        if not out or out[-1] != kind:
            out.append(kind)
    return bytes(out)


class Buckets(dict):
    """The two buckets of a word, its own and its shape's; remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = (xxhash.xxh3_64_intdigest(word) % BUCKETS, xxhash.xxh3_64_intdigest(b"\n" + word_shape(word)) % BUCKETS)
        return value


def _length_bucket(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(f"\nlength {len(words).bit_length()}".encode()) % BUCKETS


def features(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share of words) of one text; its length is a feature too."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    length = _length_bucket(words)
    if not words:
        return np.array([length]), np.array([0.1])
    pairs = np.array([buckets[w] for w in words], np.int64).ravel()
    own, counts = np.unique(pairs, return_counts=True)
    return np.append(own, length), np.append(counts / len(words), 0.1)


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds: P(grade <= k) = logistic(threshold k - text . weights)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, values: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each linear value."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - values[:, None], -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = 150, decay: float = 1e-6) -> OrdinalModel:
    """Maximum likelihood by Adam on all given rows; thresholds stay ordered, as first value and positive gaps."""
    levels = int(grades.max(initial=0))
    if levels < 1:
        return OrdinalModel(np.zeros(BUCKETS), np.array([-20.0 if len(grades) else 0.0]))
    index = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weights, start, gaps = np.zeros(BUCKETS), 0.0, np.zeros(levels - 1)
    share = np.array([(grades >= k).mean() for k in range(1, levels + 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log((1 - share) / share)
    start, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, np.zeros(1), gaps)]
    rates = (0.5, 0.05, 0.05)
    for step in range(1, steps + 1):
        cuts = start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        linear = np.bincount(row, values * weights[index], len(rows))
        below = 1 / (1 + np.exp(np.clip(linear[:, None] - cuts[None, :], -40, 40)))  # P(grade <= k - 1)
        padded = np.hstack([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))])
        hi, lo = padded[np.arange(len(rows)), grades + 1], padded[np.arange(len(rows)), grades]
        chance = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        by_linear = (slope_hi - slope_lo) / len(rows)  # of the negative log likelihood
        by_cut = np.zeros(levels)
        for k in range(levels):
            by_cut[k] = (slope_lo[grades == k + 1].sum() - slope_hi[grades == k].sum()) / len(rows)
        parts = (
            np.bincount(index, values * by_linear[row], BUCKETS) + decay * weights, np.array([by_cut.sum()]),
            np.exp(gaps) * np.array([by_cut[k:].sum() for k in range(1, levels)]),
        )
        moved = []
        for (m, v), g, rate in zip(moments, parts, rates):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            moved.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9))
        weights -= moved[0]
        start -= moved[1][0]
        gaps -= moved[2]
    return OrdinalModel(weights, start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    buckets = Buckets()
    for batch in batches:
        found = [features(t, buckets) for t in batch["text"]]
        yield pd.DataFrame({"grade": batch["grade"], "buckets": [f[0] for f in found], "shares": [f[1] for f in found]})


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fitted on at most ``sample_rows`` rated documents (doc_id, grade), those of least id hash."""
    rated = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    # the bound on the rated side is the parameter
    sample = rated.orderBy(F.xxhash64("doc_id"), "grade").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("grade").cast("int"), "text")
    rows = texts.mapInPandas(_featurise, "grade int, buckets array<bigint>, shares array<double>").toArrow()
    data = [
        (b.values.to_numpy(zero_copy_only=False), s.values.to_numpy(zero_copy_only=False)) for b, s in zip(rows["buckets"], rows["shares"])
    ]
    return fit(data, rows["grade"].to_numpy().astype(np.int64))


def _score(shared):
    """Expected grade and tail probabilities of whole texts; what a word adds is remembered, up to a bound."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model: OrdinalModel = shared.value
        weights = model.weights

        class Values(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) > MEMO:
                    self.clear()
                own, shape = Buckets().__missing__(word)
                value = self[word] = float(weights[own] + weights[shape])
                return value

        values = Values()
        for series in texts:
            linear = np.zeros(len(series))
            for i, text in enumerate(series):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                total = sum(map(values.__getitem__, words)) / len(words) if words else 0.0
                linear[i] = total + 0.1 * weights[_length_bucket(words)]
            tails = model.tails(linear)
            yield pd.DataFrame({"expected": tails.sum(axis=1), "tails": list(tails)})

    return run


def grade_texts(
    docs: DataFrame, ratings: DataFrame, tail: int = 1, least: float = 0.5, parts: int = 5, held_out_part: int = 0,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with held_out, expected_grade, tail_score and kept.

    ``ratings`` (doc_id, grade 0, 1, 2, ...) are learned from only where crc32(doc_id as text)
    modulo ``parts`` is not ``held_out_part``, from at most ``sample_rows`` of them. tail_score is
    P(grade >= ``tail``), and kept where that is at least ``least``. Every whole text is scored.

    Null or empty text has its length as only feature. Null ids are scored and never learned
    from, as are null grades. Repeated rows get equal scores. Without ratings every document has
    the same score. An empty table gives an empty result.
    """
    learned = ratings.filter(bucket_of(F.col("doc_id"), parts) != held_out_part)
    model = train(docs, learned, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = F.pandas_udf(_score(shared), "expected double, tails array<double>", F.PandasUDFType.SCALAR_ITER)
    judged = packed(docs).withColumn("scored", score(F.col("row.text").cast("string")))
    reached = F.coalesce(F.get(F.col("scored.tails"), F.lit(tail - 1)), F.lit(0.0))
    return unpacked(
        judged, held_out=F.coalesce(bucket_of(F.col("row.doc_id"), parts) == held_out_part, F.lit(False)),
        expected_grade=F.col("scored.expected"), tail_score=reached, kept=reached >= least,
    )
