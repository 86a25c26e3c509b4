import zlib
from collections import defaultdict

import numpy as np
import pytest

from arqueo.llm.packing import OpenWindows, WordIds, pack
from arqueo.llm.queries import op2_packing, tokenizer_file
from tests.llm.cases import SF, documents, empty, odd


def whole(rows, texts):
    """Asserts that the pieces of each document are its ids, each once, and that sequences have no gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(wanted)
    for doc_id, docs in wanted.items():
        got = sum(r.length for r in pieces[doc_id])
        assert got == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(docs[0])
                at += r.length
                assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in docs[0][r.start:at]))
    padding = total = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding / total


def test_documents_in_many_partitions(spark):
    texts = documents(spark)[["doc_id", "text"]].itertuples(index=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(20)
    assert whole(pack(docs, tokenizer_file()).collect(), texts) < 0.01


def test_query(spark):
    rows = op2_packing(spark, SF).collect()
    assert whole(rows, documents(spark)[["doc_id", "text"]].itertuples(index=False)) < 0.01


def test_odd_rows(spark):
    docs = odd(spark)
    whole(pack(docs, tokenizer_file()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert pack(empty(spark), tokenizer_file()).count() == 0


def test_word_ids_are_those_of_the_whole_text():
    """Words that go to the model directly, and those that do not."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:400]
    texts += ["It's O'Neil’s 3rd naïve café… İstanbul ΣΟΦΟΣ e\u0301cole ½ x² ﬁn", "日本語 a\x85b\xa0c <|endoftext|> don't!? ...", "\x1c a\x1fb", "ǅ Ǆ ß ẞ"]
    tokenizer, ids = Tokenizer.from_file(tokenizer_file()), WordIds(tokenizer_file(), 2)
    assert ids.direct
    for text, found in zip(texts, ids(texts)):
        assert np.frombuffer(found, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_ids_come_along(spark):
    docs = spark.createDataFrame([(1, "Some words, here."), (2, None)], "doc_id bigint, text string")
    rows = pack(docs, tokenizer_file(), with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


@pytest.mark.parametrize("sizes", [[9, 5, 4, 6, 3, 16, 40, 1, 1, 15], [7] * 30])
def test_open_windows_stay_bounded(sizes):
    closed = []
    windows = OpenWindows(16, 3, 2, closed.append)
    for k, n in enumerate(sizes):
        windows.add((k, n), 0, memoryview(bytes(4 * n)))
        assert len(windows.gaps) <= 3
    lengths = [sum(len(p[2]) // 4 for p in w) for w in closed]
    assert all(n > 14 for n in lengths) and sum(lengths) + sum(len(p[2]) // 4 for p in windows.rest()) == sum(sizes)
