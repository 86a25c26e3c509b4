"""The pipeline against its stages done by hand."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from arqueo.llm.common import SPACES
from arqueo.llm.packing import WordIds
from arqueo.llm.queries import tokenizer_file
from arqueo.llm.toxicity import train
from tests.llm.cases import SF, documents, empty, odd
from tests.llm.test_mixing import by_hand, targets_of
from tests.llm.test_near_dedup import brute as components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def lines_kept(texts):
    """{doc_id: text} without lines that a smaller document holds."""
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 10:
                first.setdefault(key, i)
    return {
        i: "\n".join(x for x in t.split("\n") if len(k := lower(x.strip(SPACE))) < 10 or first[k] == i) for i, t in texts.items()
    }


def test_stages_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "source mix", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), SF).columns == docs.columns


def test_stages_take_odd_rows_and_clashing_columns(spark):
    docs = odd(spark).withColumns({c: F.lit(f"own {c}") for c in ("id", "times", "nth", "n_lines", "kept_text", "h", "rest", "component_id", "taken", "held_out")})
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    given = sorted(map(str, docs.select(*[f"`{c}`" for c in own]).collect()))
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], (16, 16, 16, 48)):
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        kept = out.collect()
        left = sorted(str(r) for r in out.select(*[f"`{c}`" for c in own]).collect())
        assert len(kept) <= rows and set(left) <= set(given), name
        if name == "line dedup":
            assert left == given and all(r.n_chars == len(r.text) for r in kept)
        assert stage(spark, empty(spark), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == 14


def test_mix_keeps_a_source_of_one_long_document(spark):
    """The last document of a source is cut where the mix ends, not dropped."""
    long = " \n".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, long, "a", len(long)), (2, "one two", "a", 7), *[(i, "x y z", "b", 5) for i in range(3, 900)], (900, "", "b", 0)],
                                 "doc_id bigint, text string, source string, n_chars bigint")
    out = corpus_pipeline.source_mix(spark, docs, SF).collect()
    words = {s: sum(len(WORD.findall(r.text)) for r in out if r.source == s) for s in "ab"}
    total = 3002 + 3 * 897
    assert abs(words["a"] - total / 3) <= 3 * 64 and abs(words["b"] - 2 * total / 3) <= 3 * 64
    cut = [r for r in out if r.doc_id == 1]
    assert len(cut) == 1 and long.startswith(cut[0].text) and cut[0].n_chars == len(cut[0].text) and all(r.doc_id != 900 for r in out)


def test_run_agrees_with_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    score = train(docs, labels).scorer()
    texts = {i: t for i, t in documents(spark)[["doc_id", "text"]].itertuples(index=False, name=None) if score(t) < 0.5}
    texts = lines_kept(texts)
    same = components(texts.items(), 5)
    texts = {i: t for i, t in texts.items() if same[i][1] == i}
    source = dict(documents(spark)[["doc_id", "source"]].itertuples(index=False, name=None))
    mixed = [(i, source[i], t) for i, t in texts.items()]
    wanted = {}
    for i, n in by_hand(mixed, targets_of(spark, mixed)).items():
        size = len(WORD.findall(texts[i]))
        copies = [texts[i]] * (n // size) if size else []
        if size and n % size:
            copies.append(re.match(rf"(?:{SPACES[:-1]}*{WORD.pattern}){{{n % size}}}", texts[i]).group())
        tokens = [len(ids) // 4 for ids in WordIds(tokenizer_file(), 2)(copies)]
        if tokens:
            wanted[i] = sorted(tokens)

    rows = corpus_pipeline.run(spark, SF).collect()
    got, at = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    # every copy of every document is there, packed whole
    assert set(got) == set(wanted)
    for i, pieces in got.items():
        assert sum(n for _, n, _ in pieces) == sum(wanted[i]) and {t for _, _, t in pieces} == set(wanted[i])
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
