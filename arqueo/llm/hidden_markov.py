"""LM scoring: a hidden Markov language model trained by Baum-Welch on Spark, and exact likelihoods."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import bucket_of, packed, stored, unpacked

STATES = 8
ROUNDS = 3
HEAD_WORDS = 40_000  # words with an emission of their own, at most
COUNTED_WORDS = 1_000_000  # words whose counts every task holds, at most (12 bytes each)
CLASSES = 1024  # of the other words, by their last bytes
SEGMENT = 512
PRIOR = 200.0  # pseudo-tokens of the overall distribution in every state, at least
SAMPLE_DOCS, SAMPLE_TOKENS = 1000, 4096  # documents and tokens of each that the first guess is made from
END = b""
ENCODED = (
    "key bigint, doc_id bigint, text_hash bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, symbols binary, "
    "words array<binary>, times array<int>"
)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end; bytes know only ASCII case and white space."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(words_of(text))
            if len(counts) > 300_000:
                yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                counts.clear()
    yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c, h, class, bin) of every distinct token of ``texts``, counted over all of them."""
    counts = texts.select("text").mapInPandas(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    # exact small counts, then 64 bins an octave: few bins, whatever the corpus
    size = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(64 * F.log2(F.col("c") / 4096.0))).cast("int")
    return stored(counts.select(
        "word", "c", F.xxhash64("word").alias("h"), (F.crc32(F.substring("word", -3, 3)) % CLASSES).cast("int").alias("class"), size.alias("bin")
    ), "counts")


def _least_bin(bins: list[tuple[int, int]], most: int) -> int:
    """The smallest bin such that at most ``most`` words lie in it and above."""
    total, least = 0, 1 << 30
    for size, n in sorted(bins, reverse=True):
        total += n
        if total > most:
            break
        least = size
    return least


@dataclass
class Vocabulary:
    """What every task needs; all parts are bounded by parameters."""

    symbols: dict[bytes, int]
    hashes: np.ndarray  # sorted hashes of the words whose counts are held
    counts: np.ndarray
    class_total: np.ndarray  # log of the mass of each class of words outside ``symbols``
    tokens: int
    distinct: int
    overall: np.ndarray  # smoothed share of each symbol

    @property
    def size(self) -> int:
        return len(self.symbols) + CLASSES


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS, counted_words: int = COUNTED_WORDS) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least bin of counts that it holds."""
    bins = [(r.bin, r.n) for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()]
    if head_words + CLASSES >= 1 << 16 or counted_words < head_words:
        raise ValueError("head_words must leave room for the classes in 16 bits, and be counted")
    head_bin, counted_bin = _least_bin(bins, head_words), _least_bin(bins, counted_words)
    is_head = (F.col("bin") >= head_bin) | (F.octet_length("word") == 0)
    # Arrow tables: rows as objects would take many times the bytes
    head = counts.filter(is_head).select("word", "c").toArrow().to_pydict()
    head = sorted(zip(head["word"], head["c"]), key=lambda r: (-r[1], r[0]))
    symbols = {word: i for i, (word, _) in enumerate(head)}
    symbols.setdefault(END, len(symbols))
    sizes = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    held = counts.filter(F.col("bin") >= counted_bin).select("h", "c").toArrow()
    hashes, held_counts = (held[c].to_numpy() for c in ("h", "c"))
    order = np.argsort(hashes)
    per_class = counts.filter(~is_head).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    tokens, mass = np.zeros(CLASSES), np.ones(CLASSES)
    for r in per_class:
        tokens[r["class"]], mass[r["class"]] = r.c, r.c + r.v + 1
    every = np.ones(len(symbols) + CLASSES)
    for word, c in head:
        every[symbols[word]] += c
    every[len(symbols):] += tokens
    return Vocabulary(
        symbols, hashes[order], held_counts[order], np.log(mass), sizes.n, sizes.v, every / every.sum()
    ), counted_bin


def _encode(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Vocabulary = shared.value
        key = TaskContext.get().partitionId() << 40
        first_class, total = len(known.symbols), np.log(known.tokens + known.distinct + 1)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.iloc[at:at + 500], []
                for text in part["text"]:
                    words = words_of(text)
                    ids = np.fromiter((known.symbols.get(w, -1) for w in words), np.int64, len(words))
                    other = np.flatnonzero(ids < 0)
                    rare = [words[i] for i in other]
                    kinds = np.fromiter((zlib.crc32(w[-3:]) % CLASSES for w in rare), np.int64, len(rare))
                    ids[other] = first_class + kinds
                    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
                    place = np.minimum(np.searchsorted(known.hashes, hashes), max(len(known.hashes) - 1, 0))
                    found = known.hashes[place] == hashes if len(known.hashes) else np.zeros(len(words), bool)
                    c = known.counts[place[found]] if found.any() else np.empty(0, np.int64)
                    base = (np.log(c + 1.0) - total).sum()
                    some = found[other]
                    inside = (np.log(known.counts[place[other[some]]] + 1.0) - known.class_total[kinds[some]]).sum() if some.any() else 0.0
                    rest = Counter(words[i] for i in np.flatnonzero(~found))
                    rows.append((key, len(words), int(found.sum()), base, inside, ids.astype(np.uint16).tobytes(), list(rest), list(rest.values())))
                    key += 1
                out = pd.DataFrame(rows, columns=["key", "n_tokens", "n_known", "base", "inside", "symbols", "words", "times"])
                for c in ("doc_id", "text_hash", "held_out"):
                    out[c] = part[c].to_numpy()
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


class Chain:
    """Start, transition and emission probabilities; ``emit`` has a row per symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each sequence: the scaled forward recursion, all texts in step."""
        out, order, symbols, first, active = _in_step(texts)
        alpha = None
        for t, n in enumerate(active):
            seen = self.emit[symbols[first[:n] + t]]
            alpha = seen * self.start if alpha is None else (alpha[:n] @ self.move) * seen
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:n] += np.log(scale)
        back = np.empty_like(out)
        back[order] = out
        return back

    def expected(self, texts: list[np.ndarray], begins: np.ndarray, steady: np.ndarray, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
        """Adds the expected emissions, moves and starts of ``texts`` to the last three arguments."""
        _, order, symbols, first, active = _in_step(texts)
        begins = begins[order]
        alphas, scales, seen = [], [], []
        for t, n in enumerate(active):
            seen.append(self.emit[symbols[first[:n] + t]])
            alpha = seen[t] * np.where(begins[:n, None], self.start, steady) if t == 0 else (alphas[-1][:n] @ self.move) * seen[t]
            scales.append(alpha.sum(axis=1))
            alphas.append(alpha / scales[t][:, None])
        gammas, at, beta = [None] * len(active), [None] * len(active), np.empty((0, len(self.start)))
        for t in range(len(active) - 1, -1, -1):
            n, later = active[t], len(beta)
            if later:
                ahead = seen[t + 1] * beta / scales[t + 1][:, None]
                moves += self.move * (alphas[t][:later].T @ ahead)
                beta = ahead @ self.move.T
            if n > later:
                beta = np.vstack([beta, np.ones((n - later, len(self.start)))])
            gammas[t], at[t] = alphas[t] * beta, symbols[first[:n] + t]
        starts += gammas[0][begins].sum(axis=0)
        flat, weights = np.concatenate(at), np.concatenate(gammas)
        for s in range(len(self.start)):
            counts[:, s] += np.bincount(flat, weights[:, s], len(counts))


def _in_step(texts: list[np.ndarray]):
    """Longest first: (zeros, order, all symbols, where each text begins, texts that reach each step)."""
    lengths = np.array([len(x) for x in texts])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    symbols = np.concatenate([texts[i] for i in order]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    return np.zeros(len(texts)), order, symbols, first, active


def _expect(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, steady = shared.value
        counts, moves, starts = np.zeros_like(chain.emit), np.zeros_like(chain.move), np.zeros_like(chain.start)
        held, begins, size = [], [], 0
        for batch in batches:
            for data in batch["symbols"]:
                text = np.frombuffer(data, np.uint16)
                for at in range(0, len(text), SEGMENT):
                    held.append(text[at:at + SEGMENT])
                    begins.append(at == 0)
                    size += len(held[-1])
                    if size > 300_000:
                        chain.expected(held, np.array(begins), steady, counts, moves, starts)
                        held, begins, size = [], [], 0
        if held:
            chain.expected(held, np.array(begins), steady, counts, moves, starts)
        used = np.flatnonzero(counts.any(axis=1))
        rows = np.vstack([counts[used], moves, starts[None]])
        out = pd.DataFrame(rows, columns=[f"e{s}" for s in range(rows.shape[1])])
        out.insert(0, "symbol", np.concatenate([used, -1 - np.arange(len(moves)), [-1 - len(moves)]]))
        yield out

    return run


def _smoothed(counts: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Emissions from counts, mixed with the overall shares by as many tokens as a state has kinds of them (Witten-Bell)."""
    kinds = np.maximum(np.minimum(counts, 1.0).sum(axis=0), PRIOR)
    emit = counts + kinds * overall[:, None]
    return emit / emit.sum(axis=0)


def first_guess(sample: list[np.ndarray], known: Vocabulary, states: int) -> Chain:
    """A chain from a mixture of unigrams over a bounded sample: states that keep to their texts."""
    size = known.size
    common = np.argsort(-known.overall, kind="stable")[:2000]
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    rows = np.zeros((len(sample), len(common)))
    for i, text in enumerate(sample):
        at = place[text.astype(np.int64)]
        rows[i] = np.bincount(at[at >= 0], minlength=len(common))
    counts = np.zeros((size, states))
    if len(sample):
        roots = np.sqrt(rows / np.maximum(rows.sum(axis=1, keepdims=True), 1))
        chosen = [int(rows.sum(axis=1).argmax())]
        far = ((roots - roots[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < min(states, len(sample)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((roots - roots[chosen[-1]]) ** 2).sum(axis=1))
        base = known.overall[common] / known.overall[common].sum()
        parts = (rows[chosen] + 50 * base) / (rows[chosen].sum(axis=1, keepdims=True) + 50)
        weights = np.full(len(chosen), 1 / len(chosen))
        for _ in range(20):
            logs = rows @ np.log(parts).T + np.log(weights)
            share = np.exp(logs - logs.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            parts = share.T @ rows + 50 * base
            parts /= parts.sum(axis=1, keepdims=True)
            weights = (share.sum(axis=0) + 1) / (len(sample) + len(chosen))
        for k in range(len(chosen)):
            found = np.zeros(size)
            for text, w in zip(sample, share[:, k]):
                if w > 1e-6:
                    found += w * np.bincount(text, minlength=size)
            counts[:, k] = found
    emit = _smoothed(counts, known.overall)
    stay = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Chain(np.full(states, 1 / states), stay, emit)


def _maximise(sums: pd.DataFrame, chain: Chain, overall: np.ndarray) -> tuple[Chain, np.ndarray]:
    values = sums.set_index("symbol")
    states = len(chain.start)
    counts = np.zeros_like(chain.emit)
    emissions = values[values.index >= 0]
    counts[emissions.index.to_numpy()] = emissions.to_numpy()
    moves = np.vstack([values.loc[-1 - s].to_numpy() for s in range(states)]) + 1.0
    starts = values.loc[-1 - states].to_numpy() + 1.0
    steady = (counts.sum(axis=0) + 1) / (counts.sum() + states)
    return Chain(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), _smoothed(counts, overall)), steady


def train(encoded: DataFrame, known: Vocabulary, states: int = STATES, rounds: int = ROUNDS, sample_docs: int = SAMPLE_DOCS) -> Chain:
    """Baum-Welch over every training text.

    Each task adds up expected counts over its texts; Spark sums them by symbol. What reaches
    the driver is one row per symbol, whatever the corpus. Texts are cut into segments of 512
    tokens here (not in scoring), so that many of them go step by step together.
    """
    spark, texts = encoded.sparkSession, encoded.filter(~F.col("held_out")).select("key", "symbols")
    # keys first: every task offers its least hashes, and those must not carry texts
    keys = texts.select("key").orderBy(F.xxhash64("key")).limit(sample_docs)
    sample = texts.join(F.broadcast(keys), "key").orderBy("key").select(F.substring("symbols", 1, 2 * SAMPLE_TOKENS).alias("symbols")).collect()
    chain = first_guess([np.frombuffer(bytes(r.symbols), np.uint16) for r in sample], known, states)
    steady = chain.start
    for _ in range(rounds if sample else 0):
        shared = spark.sparkContext.broadcast((chain, steady))
        found = texts.mapInPandas(_expect(shared), "symbol int, " + ", ".join(f"e{s} double" for s in range(states)))
        sums = found.groupBy("symbol").agg(*[F.sum(f"e{s}").alias(f"e{s}") for s in range(states)]).toArrow().to_pandas()
        chain, steady = _maximise(sums, chain, known.overall)
        shared.unpersist()
    return chain


def _likelihood(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = shared.value
        held, size = [], 0

        def frame() -> pd.DataFrame:
            out = pd.concat(held, ignore_index=True)
            out["path"] = chain.likelihoods([np.frombuffer(x, np.uint16) for x in out["symbols"]])
            return out.drop(columns="symbols")

        for batch in batches:
            sizes = batch["symbols"].map(len).cumsum()
            # about 8 MB of symbols at a time
            for _, part in batch.groupby(sizes // 8_000_000, sort=False):
                held.append(part)
                size += part["symbols"].map(len).sum()
                if size > 8_000_000:
                    yield frame()
                    held, size = [], 0
        if held:
            yield frame()

    return run


def score_texts(
    docs: DataFrame, learn_parts: int = 7, held_out_part: int = 2, states: int = STATES, rounds: int = ROUNDS,
    head_words: int = HEAD_WORDS, counted_words: int = COUNTED_WORDS,
) -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the texts whose crc32(doc_id as text) modulo ``learn_parts`` is not
    ``held_out_part``. Words are counted over all of them. The ``head_words`` most frequent ones
    have emissions of their own; any other word is emitted as one of 1,024 classes (by its last
    bytes) and then by its add-one share of that class, so unseen words have a probability too.
    ``score`` is the exact log10 probability of the whole text under the chain, ``base_score``
    that of the add-one unigram model.

    Counts of at most ``counted_words`` words are known to every task, as two number arrays; all
    other words meet their counts in a join by word, once per text and word. Null or empty text
    is the end token alone. A null doc_id is learned from. Repeated rows count as often as they
    occur and get the same scores. Without training texts every base score is 0. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(bucket_of(F.col("doc_id"), learn_parts) == held_out_part, F.lit(False))
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")
    ).withColumn("text_hash", F.xxhash64("text"))
    counts = word_counts(whole.filter(~F.col("held_out")))
    known, least = vocabulary(counts, head_words, counted_words)
    shared = spark.sparkContext.broadcast(known)
    encoded = stored(whole.mapInPandas(_encode(shared), ENCODED), "encoded")
    chain = train(encoded, known, states, rounds)

    total = float(np.log(known.tokens + known.distinct + 1))
    rare = encoded.select("key", F.explode(F.arrays_zip("words", "times")).alias("e")).select("key", "e.words", "e.times")
    masses = spark.createDataFrame([(i, float(x)) for i, x in enumerate(known.class_total)], "class int, mass double")
    kinds = (F.crc32(F.substring("words", -3, 3)) % CLASSES).cast("int")
    log_count = F.log(F.coalesce("c", F.lit(0)) + 1.0)
    rest = (
        rare.join(counts.filter(F.col("bin") < least).select(F.col("word").alias("words"), "c"), "words", "left")
        .withColumn("class", kinds).join(F.broadcast(masses), "class")  # 1,024 rows
        .groupBy("key").agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * (log_count - total)).alias("more_base"), F.sum(F.when(F.octet_length("words") > 0, F.col("times") * (log_count - F.col("mass"))).otherwise(0.0)).alias("more_inside"),
        )
    )
    slim = ["key", "doc_id", "text_hash", "held_out", "n_tokens", "n_known", "base", "inside", "symbols"]
    fields = [f for f in ENCODED.split(", ") if f.split()[0] in slim[:-1]]
    chains = spark.sparkContext.broadcast(chain)
    scored = encoded.select(*slim).mapInPandas(_likelihood(chains), ", ".join([*fields, "path double"])).join(rest, "key", "left")
    log10 = float(np.log(10))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    result = scored.select(
        "doc_id", "text_hash", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).cast("bigint").alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"), ((F.col("base") + more("more_base")) / log10).alias("base_score"),
        ((F.col("path") + F.col("inside") + more("more_inside")) / log10).alias("score"),
    )
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if [c.lower() for c in docs.columns] in (["doc_id"], ["doc_id", "text"]):
        return result.select("doc_id", *added)
    once = stored(result, "scores").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(*[F.first(c).alias(f"the_{c}") for c in added])
    own = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text_hash=F.xxhash64(F.col("text").cast("string")))
    both = own.join(once, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    return unpacked(both, **{c: F.col(f"the_{c}") for c in added})
