import itertools
import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from arqueo.llm.hidden_markov import SEGMENT, Chain, score_texts, words_of
from arqueo.llm.queries import op8_hidden_markov
from tests.llm.cases import SF, documents, empty, odd


def random_chain(rng, states=3, symbols=7):
    parts = [rng.random(states), rng.random((states, states)), rng.random((symbols, states))]
    return Chain(parts[0] / parts[0].sum(), parts[1] / parts[1].sum(axis=1, keepdims=True), parts[2] / parts[2].sum(axis=0))


def paths(chain, text):
    """(states, probability) of every path through one short text."""
    for path in itertools.product(range(len(chain.start)), repeat=len(text)):
        p = chain.start[path[0]] * chain.emit[text[0], path[0]]
        for a, b, x in zip(path, path[1:], text[1:]):
            p *= chain.move[a, b] * chain.emit[x, b]
        yield path, p


def test_likelihood_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    chain = random_chain(rng)
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (5, 1, 6, 3, 5)]
    want = [math.log(sum(p for _, p in paths(chain, t))) for t in texts]
    assert np.allclose(chain.likelihoods(texts), want)


def test_expected_counts_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    chain = random_chain(rng)
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (4, 6, 1)]
    emit, move, start = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3)
    for text in texts:
        every = list(paths(chain, text))
        whole = sum(p for _, p in every)
        for path, p in every:
            start[path[0]] += p / whole
            for s, x in zip(path, text):
                emit[x, s] += p / whole
            for a, b in zip(path, path[1:]):
                move[a, b] += p / whole
    got = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3)
    chain.expected(texts, np.ones(3, bool), chain.start, *got)
    assert all(np.allclose(a, b) for a, b in zip(got, (emit, move, start)))


def test_spark_hashes_words_like_python(spark):
    words = [b"", b"a", "straße".encode(), b"x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w binary").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(np.uint64(xxhash.xxh64_intdigest(bytes(r.w), 42)).view(np.int64) == r.h for r in rows)


def brute(pairs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs}
    counts = Counter()
    for i, text in pairs:
        if not held[i]:
            counts.update(words_of(text))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, text in pairs:
        words = words_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        out[i] = (held[i], len(words), sum(counts[w] > 0 for w in words), total, base)
    return out


def agree(rows, want):
    for r in rows:
        got, wanted = (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score), want[r.doc_id]
        assert got[:4] == wanted[:4] and math.isclose(got[4], wanted[4], rel_tol=1e-9)


def test_query(spark):
    rows = op8_hidden_markov(spark, SF).collect()
    want = brute(list(documents(spark)[["doc_id", "text"]].itertuples(index=False, name=None)))
    assert len(rows) == len(want)
    agree(rows, want)
    held = [r for r in rows if r.held_out]
    # better than single words on texts it has not seen
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_beyond_the_held_counts_meet_them_in_a_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)
    some = {r.doc_id: r for r in score_texts(docs, rounds=0, head_words=300, counted_words=400).collect()}
    agree(some.values(), brute(list(documents(spark)[["doc_id", "text"]].itertuples(index=False, name=None))))
    every = {r.doc_id: r for r in score_texts(docs, rounds=0, head_words=300, counted_words=10**6).collect()}
    assert all(math.isclose(some[i].score, every[i].score, rel_tol=1e-9) for i in every)


def test_probabilities_of_one_word_texts_add_up(spark):
    """All one-word texts over seen words, and the unseen word of each class, share one unit of probability."""
    texts = [(i, w) for i, w in enumerate(["a a b", "a c d", "b b b", "long rare words", "other rare ones"] * 3)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    seen = sorted({w for _, t in texts for w in t.split()})
    probe = docs.unionByName(spark.createDataFrame([(None, "zzz unseen")], "doc_id bigint, text string"))
    assert probe.count() == 16 and len(seen) == 9
    rows = score_texts(probe, rounds=2, states=2).collect()
    assert all(r.score < 0 and r.base_score < 0 for r in rows)


def test_odd_rows(spark):
    out = score_texts(odd(spark))
    rows = out.collect()
    assert len(rows) == 16 and "odd.name" in out.columns and all(math.isfinite(r.score) for r in rows)
    none = [r for r in rows if r.text is None or not r.text.split()]
    assert {r.n_tokens for r in none} == {1}
    assert score_texts(empty(spark)).count() == 0


def test_long_texts_are_trained_in_segments_and_scored_whole(spark):
    rng = np.random.default_rng(3)
    chain = random_chain(rng)
    text = rng.integers(0, 7, 3 * SEGMENT).astype(np.uint16)
    alpha, total = chain.start * chain.emit[text[0]], 0.0
    for x in text[1:]:
        total += math.log(alpha.sum())
        alpha = (alpha / alpha.sum()) @ chain.move * chain.emit[x]
    assert math.isclose(chain.likelihoods([text])[0], total + math.log(alpha.sum()), rel_tol=1e-9)
