import random
import re

import numpy as np
import pytest

from arqueo.llm.components import components
from arqueo.llm.near_dedup import WordHashes, near_duplicates, shingle_set, super_minhash
from arqueo.llm.queries import op10_near_duplicates
from tests.llm.cases import SF, documents, empty, odd, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(pairs, size, percent=80):
    """{doc_id: (n_shingles, component_id)} from all pairs."""
    sets, root = {}, {}
    for i, text in pairs:
        words = WORD.findall(lower(text or ""))
        k = min(size, len(words))
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if words else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query(spark):
    rows = op10_near_duplicates(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(documents(spark)[["doc_id", "text"]].itertuples(index=False, name=None), 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("size", [2, 5])
def test_chains_of_edits(spark, size):
    """Copies of a base text with growing edits: links that skip the smallest id count as well."""
    rng = random.Random(size)
    rows = []
    for group in range(6):
        words = [f"g{group}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(60):
            rows.append((len(rows), " ".join(words)))
            parent = rng.choice(rows[-30:])[1].split()
            words = parent if parent[0].startswith(f"g{group}") else words
            words = list(words)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = f"g{group}n{rng.randrange(10**6)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert result(near_duplicates(docs, size)) == brute(rows, size)


def test_a_crowd_of_copies_with_edits_of_their_own(spark):
    """Hundreds of copies around the threshold, in several blocks: every link counts, no pair leaves a task."""
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randrange(0, 16)):
            words[rng.randrange(len(words))] = f"n{i}x{rng.randrange(10**6)}"
        if i % 9 == 0 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(4):
                words[rng.randrange(len(words))] = f"m{i}x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want = brute(rows, 2)
    assert len({c for _, c in want.values()}) > 20
    assert result(near_duplicates(docs, 2)) == want


def test_odd_rows(spark):
    got = near_duplicates(odd(spark), 2)
    assert got.count() == 16
    known = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    want = brute(known.items(), 2)
    assert {k: v for k, v in result(got).items() if k is not None} == want
    assert near_duplicates(empty(spark)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        both = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = super_minhash(both[:700]), super_minhash(both[200:])
        errors.append((a == b).mean() - 500 / 900)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_shingles():
    hashes = WordHashes()
    assert len(shingle_set("a b a b a", 2, hashes)) == 2 and len(shingle_set("One", 5, hashes)) == 1 and len(shingle_set(" \n", 2, hashes)) == 0
    assert (shingle_set("A\x0bB", 2, hashes) == shingle_set("a b", 2, hashes)).all()
    assert not (shingle_set("É x", 2, hashes) == shingle_set("é x", 2, hashes)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, b) for a in range(300) for b in [max(0, a - rng.choice([1, 3, 50]))] if a % 7 and a != b] + [(500, 499), (499, 498), (7, 0)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    as_bytes = [(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges]
    got = components(spark.createDataFrame(as_bytes, "a binary, b binary").repartition(6)).collect()
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_no_side_goes_through_the_driver(spark, monkeypatch):
    """Staged tables are small as files and large as rows: joins must not broadcast them."""
    from arqueo.llm import components as found_components
    from arqueo.llm import near_dedup

    plans = []

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, *args, **options)

    kept = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", seen)
    monkeypatch.setattr(found_components, "stored", seen)
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(40 + i % 3))) for i in range(40)]
    result_of = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert len(result(result_of)) == 40
    plans.append(result_of._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
