import zlib

import numpy as np
import pytest
import zstandard

from arqueo.llm.queries import op3_toxicity
from arqueo.llm.toxicity import AFTER, BEFORE, _cover, _Held, _texts_holding, evidence, fit, grams, score_toxicity, train, train_dictionaries, windows
from tests.llm.cases import empty, odd

SF = "/root/testdata/sf0.1"


def samples(n, seed=1):
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "an", "en", "ion")]
    texts, toxic = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(2, 5))) for _ in range(rng.integers(40, 160))]
        if i % 4 == 0:
            for j in rng.integers(0, len(words), 4):
                words[j] = str(rng.choice(["wretchish", "Blockhead!", "nitwit", "dunceling"]))
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    return texts, np.array(toxic)


def test_dictionaries_separate_marked_windows():
    texts, toxic = samples(400)
    sets = [windows(t) for t in texts]
    trained = train_dictionaries([s for s, y in zip(sets, toxic) if y], [s for s, y in zip(sets, toxic) if not y])
    distance = trained.distance()
    assert all(distance(w) >= 3 for w in (b"wretchish", b"blockhead", b"dunceling"))
    assert np.mean([distance(w) for w in list(sets[1])[:60]]) < 1
    # the distance is the difference of two plain compression lengths
    size = {}
    for name, data in (("toxic", trained.toxic), ("ordinary", trained.ordinary)):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            9, source_size=128, dict_size=len(data), write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size[name] = len(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress(BEFORE + b" nitwit " + AFTER))
    assert distance(b"nitwit") == size["ordinary"] - size["toxic"]


def test_held_out_texts_of_a_made_up_corpus():
    score = fit(*samples(400)).scorer()
    texts, toxic = samples(200, seed=2)
    found = np.array([score(t) for t in texts])
    assert (found >= 0.5).astype(int).tolist() == pytest.approx(toxic.tolist(), abs=0) or ((found >= 0.5) == toxic).mean() > 0.97


def test_cover_takes_each_gram_once():
    worth = {g: 1.0 for g in grams(b"abcdef")} | {g: 5.0 for g in grams(b"xyz")}
    assert _cover([b"abcdef", b"abcdefg", b"xyz", b"none"], worth, 100)[0] == b"xyz"
    assert _cover([b"abcdef", b"abcdef"], worth, 100).count(b"abcdef") == 1


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op3_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    marked, clean = np.array([r.score for r in rows if r.toxic]), np.array([r.score for r in rows if not r.toxic])
    assert (marked[:, None] > clean[None, :]).mean() > 0.9
    assert (clean >= 0.5).mean() < 0.01 and (marked >= 0.5).mean() > 0.6


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    out = score_toxicity(odd(spark), labels)
    rows = out.collect()
    assert len(rows) == 16 and "odd.name" in out.columns and "text" not in out.columns
    assert all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(empty(spark), labels).count() == 0
    for some in (labels.filter("toxic = 0"), labels.limit(0)):
        assert len({r.score for r in score_toxicity(odd(spark), some).collect()}) == 1


def test_short_insults_are_marked():
    assert grams(b"oaf") == [b" oaf "] and grams(b"scum") == [b" scum "] and len(grams(b"idiot")) == 1
    texts, toxic = samples(400)
    short = ["oaf", "git", "scum", "fool"]
    # the toxic texts hold short insults only
    for i in np.flatnonzero(toxic):
        texts[i] = " ".join(w for w in texts[i].split() if w not in ("wretchish", "Blockhead!", "nitwit", "dunceling")) + f" {short[i % 3]} {short[i // 4 % 4]}"
    sets = [windows(t) for t in texts]
    distance = train_dictionaries([s for s, y in zip(sets, toxic) if y], [s for s, y in zip(sets, toxic) if not y]).distance()
    assert all(distance(w.encode()) >= 2 for w in short)
    score = fit(texts, toxic).scorer()
    clean = [texts[i] for i in np.flatnonzero(toxic == 0)[:40]]
    assert np.mean([score(f"{t} {' '.join(short)}") > score(t) for t in clean]) == 1


def test_evidence_of_rare_grams():
    # 20 of 800 against 0 of 800; 7 of 4,000 against 0 of 36,000; what is as frequent in ordinary text
    assert evidence([20], [0], 800, 800)[0] > 5 and evidence([7], [0], 4000, 36_000)[0] > 5
    assert evidence([3, 40, 0], [0, 40, 9], 800, 800).max() < 5 and evidence([5], [5], 0, 9).tolist() == [0.0]


def test_rare_kinds_are_marked_whatever_the_sample(spark):
    texts, toxic = samples(2400)
    rare = np.flatnonzero(toxic)[::10]
    for i in rare:
        texts[i] += " skunkwort"
    docs = spark.createDataFrame([(int(i), t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(int(i), int(y)) for i, y in enumerate(toxic)], "doc_id bigint, toxic int")
    assert len(rare) == 60
    # a sample of 60 texts of each label holds about six of the 60, too few to mark the word in either half
    assert all(d.distance()(b"skunkwort") >= 3 for d in train(docs, labels, sample_rows=60).dictionaries)


def test_counts_of_texts():
    texts = ["scum scum idiot", "idiots and oafs", "", None, "x" * 200 + " idiot"]
    held = _Held()
    for t in texts:
        held.add(t, 3)
    frames = [f for f in held.frames() if len(f)]
    got = {bytes(t): n for f in frames if f["kind"].iloc[0] == 0 for t, n in zip(f["token"], f["toxic"])}
    assert got == dict(_texts_holding([windows(t) for t in texts])) and got[b" scum "] == 1 and got[b" idiot "] == 2
    pieces = [bytes(t) for f in frames if f["kind"].iloc[0] == 1 for t in f["token"]]
    assert b"scum" in pieces and max(map(len, pieces)) == 64
