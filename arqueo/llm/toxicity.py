"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary dictionary."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import bucket_of, packed, stored, unpacked
from arqueo.operators.staging import broadcast_if_small

SAMPLE_ROWS = 1600  # labelled documents of each label that thresholds and weights are fitted on, at most
GRAM = 7  # bytes of the pieces that dictionary training counts
# of a dictionary: the part both have, and the part trained on one label, which grows with the marked words
SHARED_BYTES, OWN_BYTES, MOST_OWN_BYTES = 24_000, 4096, 64_000
MARKED_GRAMS = 64_000  # as many as the longest part can hold: a byte adds one gram at most
LEAST_EVIDENCE = 5.0  # standard errors
ENTRY = 64  # bytes of a window that stand in a dictionary together
SENT_LABELS = 2_000_000  # labels that are sent to the texts; more meet them in a shuffle
HELD_WINDOWS, HELD_GRAMS = 100_000, 400_000  # that a task counts before it hands them on
LEVEL = 9
# a window stands between a text that both dictionaries hold, so that its frame is always compressible,
# and one that neither holds, so that its end is searched for matches
BEFORE, AFTER = b"qwindow~that~is~measured~here", b"0123456789ab"
STEPS = (2, 3, 4, 5, 6)  # bytes saved, from which a window counts
MARKS = b".,!?;:\"'()#*$%&|<>"
MEMO = 300_000


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a text: its words in lower case, without marks at their ends."""
    words = {x.strip(MARKS) for x in set((text or "").lower().encode("utf-8", "surrogatepass").split())}
    words.discard(b"")
    return words


def grams(window: bytes) -> list[bytes]:
    """Pieces of a window with a space at each end; a window too short for one is a piece of its own."""
    padded = b" %b " % window
    return [padded[i:i + GRAM] for i in range(max(len(padded) - GRAM, 0) + 1)]


def evidence(x: np.ndarray, y: np.ndarray, n: int, m: int) -> np.ndarray:
    """How far the share of n toxic texts that hold a gram exceeds that of m ordinary ones, in standard errors.

    From the likelihood ratio of the x + y texts that hold it (a bound of the exact binomial tail),
    which is right for rare grams as well: what no ordinary text holds needs a fixed number of
    toxic texts, and so a share that falls as labels grow. 0 where the share is not above five
    times the ordinary one.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not n or not m:
        return np.zeros(len(x))
    part = lambda k, share: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum((x + y) * share, 1e-300)), 0.0)
    above = np.sqrt(2 * np.maximum(part(x, n / (n + m)) + part(y, m / (n + m)), 0.0))
    return np.where((x + 0.5) / (n + 1) > 5 * (y + 0.5) / (m + 1), above, 0.0)


def entries(window: bytes) -> list[bytes]:
    """What can stand in a dictionary for a window: itself, or pieces that hold all its grams if it is long."""
    step = ENTRY - GRAM + 1
    return [window] if len(window) <= ENTRY else [window[i:i + ENTRY] for i in range(0, len(window) - GRAM + 1, step)]


def _texts_holding(texts: list[set[bytes]]) -> Counter:
    """How many texts hold each gram."""
    counts: Counter = Counter()
    for words in texts:
        held: set[bytes] = set()
        for w in words:
            held.update(grams(w))
        counts.update(held)
    return counts


def _cover(words: Iterable[bytes], worth: dict[bytes, float], size: int) -> list[bytes]:
    """Words that cover the most worth per byte, greedily; a gram counts once. As dictionary trainers do."""
    worth, chosen, used = dict(worth), [], 0
    gain = lambda w: sum(worth.get(g, 0.0) for g in set(grams(w))) / (len(w) + 1)
    heap = [(-gain(w), w) for w in sorted(words)]
    heapq.heapify(heap)
    while heap and used < size:
        before, w = heapq.heappop(heap)
        now = gain(w)
        if now <= 0:
            continue
        if now < -before - 1e-12:
            heapq.heappush(heap, (-now, w))
            continue
        chosen.append(w)
        used += len(w) + 1
        for g in grams(w):
            worth[g] = 0.0
    return chosen


@dataclass
class Dictionaries:
    """A toxic and an ordinary dictionary that begin and end alike."""

    toxic: bytes
    ordinary: bytes

    def distance(self) -> Callable[[bytes], int]:
        """Bytes that a window takes with the ordinary dictionary, minus those with the toxic one."""
        takes = [self._size(d) for d in (self.toxic, self.ordinary)]

        def saved(window: bytes) -> int:
            framed = b"%b %b %b" % (BEFORE, window, AFTER)
            return len(takes[1](framed)) - len(takes[0](framed))

        return saved

    @staticmethod
    def _size(dictionary: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=128, dict_size=len(dictionary), write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress


def _dictionaries(marked: dict[bytes, float], common: dict[bytes, float], toxic: Iterable[bytes], ordinary: Iterable[bytes]) -> Dictionaries:
    of_toxic = _cover(toxic, marked, MOST_OWN_BYTES)
    own_bytes = max(OWN_BYTES, sum(len(w) + 1 for w in of_toxic))
    of_ordinary = _cover(ordinary, common, SHARED_BYTES + own_bytes)
    used = np.cumsum([len(w) + 1 for w in of_ordinary])
    half = int(np.searchsorted(used, SHARED_BYTES))
    shared, own = of_ordinary[:half], of_ordinary[half:]
    text = lambda words: b" " + b" ".join(reversed(words)) + b" "  # noqa: E731  the best nearest to the window
    return Dictionaries(text(shared) + text(of_toxic) + BEFORE, text(shared) + text(own) + BEFORE)


def train_dictionaries(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> Dictionaries:
    """Both dictionaries from the windows of labelled texts.

    A dictionary is a series of windows that cover the grams of its label: for ordinary text
    weighted by the texts that hold them, for toxic text by the evidence that their share is above
    that in ordinary text. The first part of the ordinary cover stands in both, so that windows of
    neither kind take the same bytes with either.
    """
    a, b = _texts_holding(toxic), _texts_holding(ordinary)
    names = sorted(a)
    above = evidence([a[g] for g in names], [b[g] for g in names], len(toxic), len(ordinary))
    marked = {g: float(z) for g, z in zip(names, above) if z > LEAST_EVIDENCE}
    pieces = lambda sets: {e for w in set().union(*sets) for e in entries(w)}
    return _dictionaries(marked, {g: float(c) for g, c in b.items() if g not in marked}, pieces(toxic), pieces(ordinary))


def _row(saved: np.ndarray, n: int) -> np.ndarray:
    """Features of a text of ``n`` windows: how many of them save at least each step, by share, and its size."""
    n = max(n, 1)
    return np.array([1.0, *[np.log1p(200 * (saved >= s).sum() / n) for s in STEPS], *[np.log1p((saved >= s).sum()) for s in STEPS[1:]], 1 / np.sqrt(n), np.log(n)])


class Measured:
    """The bytes that windows save with each of some pairs of dictionaries; a window is compressed once while it is remembered."""

    def __init__(self, pairs: list[Dictionaries]):
        self.distances, self.known, self.saving = [d.distance() for d in pairs], set(), {}

    def saved(self, words: set[bytes]) -> np.ndarray:
        """(window, pair) of those windows that save enough with any pair to count."""
        if len(self.known) + len(words) > MEMO:
            self.known, self.saving = set(), {}
        fresh = words - self.known
        for w in fresh:
            bytes_saved = [distance(w) for distance in self.distances]
            if max(bytes_saved) >= STEPS[0]:
                self.saving[w] = bytes_saved
        self.known |= fresh
        found = [self.saving[w] for w in words & self.saving.keys()]
        return np.array(found, np.int64).reshape(len(found), len(self.distances))


@dataclass
class ToxicityModel:
    """Pairs of dictionaries, each trained on one half of the sample, and what the other half made of it."""

    dictionaries: list[Dictionaries]
    weights: np.ndarray  # of the features, after scaling
    centre: np.ndarray
    scale: np.ndarray

    def scorer(self) -> Callable[[str | None], float]:
        measured = Measured(self.dictionaries)

        def score(text: str | None) -> float:
            words = windows(text)
            saved = measured.saved(words)
            rows = (np.array([_row(saved[:, k], len(words)) for k in range(saved.shape[1])]) - self.centre) / self.scale
            return float(1 / (1 + np.exp(-np.clip((rows @ self.weights).mean(), -40, 40))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[decay] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: np.ndarray, prior: float | None = None) -> ToxicityModel:
    """Two pairs of dictionaries, one from either half of the texts, and thresholds calibrated on the other half.

    A dictionary fits its own texts better than any others, so it is only judged by texts it has
    not seen, as it will be in use. ``prior`` is the share of toxic texts that scores are
    calibrated to, if the sample's is another.
    """
    if (toxic == 1).sum() < 2 or (toxic == 0).sum() < 2:
        return unlearned(toxic.mean() if len(toxic) else 0.0)
    sets, half = [windows(t) for t in texts], np.zeros(len(texts), int)
    for label in (0, 1):
        own = np.flatnonzero(toxic == label)
        half[own] = np.arange(len(own)) % 2
    pick = lambda part, label: [sets[i] for i in np.flatnonzero((half == part) & (toxic == label))]
    pairs = [train_dictionaries(pick(part, 1), pick(part, 0)) for part in (0, 1)]
    return calibrate(unseen_rows(pairs, texts, half), toxic, pairs, prior)


def unlearned(share: float) -> ToxicityModel:
    """The model that gives every text the share of toxic ones."""
    base, size = np.clip(share, 1e-6, 1 - 1e-6), len(_row(np.zeros(0), 0))
    constant = np.array([np.log(base / (1 - base)), *[0.0] * (size - 1)])
    return ToxicityModel([Dictionaries(BEFORE, BEFORE)], constant, np.zeros(size), np.ones(size))


def unseen_rows(pairs: list[Dictionaries], texts: Iterable[str | None], half: Iterable[int]) -> np.ndarray:
    """The features of texts, each measured by the pair of the half it does not belong to."""
    measured, rows = [Measured([pair]) for pair in pairs], []
    for text, own in zip(texts, half):
        words = windows(text)
        rows.append(_row(measured[1 - own].saved(words)[:, 0], len(words)))
    return np.array(rows).reshape(len(rows), -1)


def calibrate(rows: np.ndarray, toxic: np.ndarray, pairs: list[Dictionaries], prior: float | None = None) -> ToxicityModel:
    if (toxic == 1).sum() < 2 or (toxic == 0).sum() < 2:
        return unlearned(toxic.mean() if len(toxic) else 0.0)
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    centre[0], scale[0] = 0.0, 1.0
    share = toxic.mean()
    prior = share if prior is None else float(np.clip(prior, 1e-4, 1 - 1e-4))
    weight = np.where(toxic == 1, prior / share, (1 - prior) / (1 - share))
    return ToxicityModel(pairs, _logistic((rows - centre) / scale, toxic, weight), centre, scale)


class _Held:
    """How many texts of each half and label hold each window's entries and each gram. A text counts once."""

    def __init__(self) -> None:
        self.windows: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.tokens: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}
        self.counts = [np.zeros((4, 2 * n), np.int32) for n in (HELD_GRAMS, HELD_WINDOWS)]
        self.last = [np.zeros(2 * n, np.int64) for n in (HELD_GRAMS, HELD_WINDOWS)]

    def _numbers(self, kind: int, tokens: list[bytes]) -> np.ndarray:
        known = self.tokens[kind]
        return np.array([known.setdefault(t, len(known)) for t in tokens], np.int64)

    def add(self, text: str | None, column: int) -> None:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for w in windows(text):
            held = self.windows.get(w)
            if held is None:
                held = self.windows[w] = self._numbers(0, grams(w)), self._numbers(1, entries(w))
            found.append(held)
        for kind in (0, 1) if found else ():
            ids = np.concatenate([f[kind] for f in found])
            while len(self.tokens[kind]) > len(self.last[kind]):
                self.last[kind] = np.concatenate([self.last[kind]] * 2)
                self.counts[kind] = np.concatenate([self.counts[kind], np.zeros_like(self.counts[kind])], axis=1)
            at = np.arange(len(ids))
            self.last[kind][ids] = at
            self.counts[kind][column, ids[self.last[kind][ids] == at]] += 1

    def full(self) -> bool:
        return len(self.tokens[0]) > HELD_GRAMS or len(self.tokens[1]) > HELD_WINDOWS

    def frames(self) -> Iterator[pd.DataFrame]:
        for kind in (0, 1):
            names, counts = np.array([*self.tokens[kind], None], object)[:-1], self.counts[kind]
            for half in (0, 1):
                own = counts[2 * half:2 * half + 2, :len(names)]
                at = np.flatnonzero(own.any(axis=0))
                for some in np.array_split(at, len(at) // 50_000 + 1):
                    yield pd.DataFrame({"half": np.int32(half), "kind": np.int32(kind), "token": names[some], "ordinary": own[0, some].astype(np.int64), "toxic": own[1, some].astype(np.int64)})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = _Held()
    for batch in batches:
        for half, toxic, text in zip(batch["half"], batch["toxic"], batch["text"]):
            held.add(text, 2 * half + toxic)
            if held.full():
                yield from held.frames()
                held = _Held()
    yield from held.frames()


def _marking(sizes: dict[tuple[int, int], int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["worth"] = 0.0
            for half in (0, 1):
                own = (batch["half"] == half).to_numpy()
                batch.loc[own, "worth"] = evidence(batch["toxic"][own], batch["ordinary"][own], sizes.get((half, 1), 0), sizes.get((half, 0), 0))
            yield batch.loc[batch["worth"] > LEAST_EVIDENCE, ["half", "token", "worth"]]

    return run


def _candidates(shared):
    """For each gram of worth the window that has most worth a byte; ``label`` tells of which dictionary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worth, best = shared.value, {}
        for batch in batches:
            for half, w, ordinary, toxic in zip(batch["half"], batch["token"], batch["ordinary"], batch["toxic"]):
                pieces = dict.fromkeys(grams(w))
                for label, n in ((0, ordinary), (1, toxic)):
                    own = worth[half, label]
                    held = [g for g in pieces if g in own] if n else ()
                    if held:
                        offer = (sum(own[g] for g in held) / (len(w) + 1), w)
                        for g in held:
                            best[half, label, g] = max(best.get((half, label, g), offer), offer)
        rows = [(*key, *offer) for key, offer in best.items()]
        yield pd.DataFrame(rows, columns=["half", "label", "gram", "gain", "token"]).astype({"half": np.int32, "label": np.int32, "gain": float})

    return run


def _pairs(found: pa.Table) -> dict[bytes, float]:
    return dict(zip(found.column("token").to_pylist(), found.column("worth").to_pylist()))


def count_dictionaries(texts: DataFrame, sizes: dict[tuple[int, int], int]) -> list[Dictionaries]:
    """train_dictionaries() for either half of ``texts`` (half, toxic, text), counted on Spark.

    ``sizes`` has the texts by half and label. Tasks add up the texts that hold each gram and each
    window, Spark sums them. Grams that mark toxic text, and the most frequent others, reach the
    driver, and for each of them the window that is best for it.
    """
    spark = texts.sparkSession
    found = texts.mapInPandas(_count, "half int, kind int, token binary, ordinary bigint, toxic bigint")
    held = stored(found.groupBy("half", "kind", "token").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "held_tokens")
    pieces, worth = held.filter("kind = 0").drop("kind"), {}
    for half in (0, 1):
        own = pieces.filter(F.col("half") == half)
        # as Arrow columns: rows of Python objects take many times their memory
        top = lambda df, n: _pairs(df.select("token", F.col("worth").cast("double").alias("worth")).orderBy(F.col("worth").desc(), "token").limit(n).toArrow())
        marked = top(own.filter("toxic > 0").mapInPandas(_marking(sizes), "half int, token binary, worth double"), MARKED_GRAMS)
        common = top(own.filter("ordinary > 0").select("token", F.col("ordinary").alias("worth")), SHARED_BYTES + OWN_BYTES + 2 * GRAM * len(marked))
        worth[half, 1], worth[half, 0] = marked, {g: c for g, c in common.items() if g not in marked}
    shared = spark.sparkContext.broadcast(worth)
    best = held.filter("kind = 1").drop("kind").select("half", "token", "ordinary", "toxic").mapInPandas(
        _candidates(shared), "half int, label int, gram binary, gain double, token binary"
    ).groupBy("half", "label", "gram").agg(F.max(F.struct("gain", "token"))["token"].alias("token"))
    words: dict[tuple[int, int], list[bytes]] = {k: [] for k in worth}
    chosen = best.select("half", "label", "token").distinct().toArrow()
    for half, label, token in zip(*[chosen.column(c).to_pylist() for c in ("half", "label", "token")]):
        words[half, label].append(token)
    shared.destroy()
    return [_dictionaries(worth[half, 1], worth[half, 0], words[half, 1], words[half, 0]) for half in (0, 1)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Dictionaries from all labelled documents, each half by text hash, so that equal texts are in one half.

    Thresholds and weights are fitted on at most ``sample_rows`` documents of each label, those of
    least id hash.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")
    )
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("half")), F.lit(2)).cast("int").alias("half")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    least = lambda label: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    total = sum(counts.values())
    labelled = texts.select("doc_id", half, "text").join(broadcast_if_small(known, SENT_LABELS), F.col("doc_id") == F.col("id"))
    sizes = {(r.half, r.toxic): r.n for r in labelled.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = [sizes.get((0, y), 0) + sizes.get((1, y), 0) for y in (0, 1)]
    if min(kinds) < 2:
        return unlearned(kinds[1] / max(sum(kinds), 1))
    pairs = count_dictionaries(labelled.select("half", "toxic", "text"), sizes)
    # ids alone are sorted; the chosen ones, twice the parameter at most, are sent to the texts, and only
    # features come back
    chosen = F.broadcast(least(1).unionByName(least(0)))
    sample = texts.join(chosen, F.col("doc_id") == F.col("id")).select("id", F.xxhash64("text").alias("nth"), "toxic", half, "text")
    rows = sample.mapInPandas(_unseen(pairs), "id bigint, nth bigint, toxic int, features array<double>").toPandas().sort_values(["id", "nth"])
    return calibrate(np.array(rows["features"].tolist()), rows["toxic"].to_numpy(), pairs, counts.get(1, 0) / total)


def _unseen(pairs: list[Dictionaries]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id", "nth", "toxic"]].assign(features=list(unseen_rows(pairs, batch["text"], batch["half"])))

    return run


def _score(shared):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for series in texts:
            yield series.map(score)

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, parts: int = 5, held_out_part: int = 0, sample_rows: int = SAMPLE_ROWS, least: float = 0.5,
) -> DataFrame:
    """``docs`` without text, with held_out, score (0 to 1) and predicted (1 from ``least`` on).

    ``labels`` (doc_id, toxic 0 or 1) are learned from only where crc32(doc_id as text) modulo
    ``parts`` is not ``held_out_part``. Every word of a whole text is a window: set into a fixed
    frame, it is compressed with either dictionary, and the bytes that the toxic one saves are
    counted against thresholds; how many windows pass them tells the score. A word is compressed
    once while a task remembers it.

    Null or empty text has no windows and the score that goes with that. Null ids are scored and
    never learned from. Repeated rows get equal scores. With labels of one kind only, or none,
    every document has the same score. An empty table gives an empty result.
    """
    learned = labels.filter(bucket_of(F.col("doc_id"), parts) != held_out_part)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learned, sample_rows))
    score = F.pandas_udf(_score(shared), "double", F.PandasUDFType.SCALAR_ITER)
    judged = packed(docs).withColumn("score", score(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    return unpacked(
        judged, held_out=F.coalesce(bucket_of(F.col("row.doc_id"), parts) == held_out_part, F.lit(False)),
        score=F.col("score"), predicted=(F.col("score") >= least).cast("int"),
    ).drop("text")
