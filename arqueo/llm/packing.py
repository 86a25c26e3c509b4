"""Packing: documents into token windows, with a fixed number of windows open at a time."""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import stored

WINDOW = 4096
OPEN = 32
MIN_CUT = 16  # a gap below this is padded, not filled with the head of the next piece
FAN_IN = 16  # partitions whose leftovers one task merges
MEMO = 400_000  # words whose ids a worker remembers
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, team int, ids binary"
)
COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


MARKS = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as the character of its number where that is visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class WordIds:
    """Token ids of whole texts as little-endian 32-bit numbers, word by word.

    Neither the normaliser nor the splitter of a word-level BPE looks across white space, so a
    text's ids are those of its words one after another; each distinct word is encoded once
    while it is remembered. Words of letters with marks behind them are one or two pieces by
    definition of such a splitter, so they go to the BPE model itself; a tokenizer that treats
    a few probe words otherwise has all its words encoded the long way.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.memo = Tokenizer.from_file(path), end_id.to_bytes(4, "little"), {}
        self.model = self.tokenizer.model
        self.direct = all(
            self._simple(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("Word", "naïve!?", "Größe.", "x,")
        )

    def _simple(self, word: str) -> list[int] | None:
        """Ids of letters and the marks behind them, straight from the model; None for any other word."""
        body = word.rstrip(MARKS)
        if body and not body.isalpha():
            return None
        if not body.isascii():
            if not unicodedata.is_normalized("NFC", body) or "İ" in body or "Σ" in body:
                return None
            body = body.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for piece in (body.lower() if body.isascii() else body, word[len(word.rstrip(MARKS)):]) if piece for t in self.model.tokenize(piece)]

    def _encode(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        hard = []
        for w in words:
            ids = self._simple(w.decode()) if self.direct else None
            if ids is None:
                hard.append(w)
            else:
                yield w, ids
        for part in range(0, len(hard), 4096):
            some = hard[part:part + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            yield from zip(some, (f.ids for f in found))

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            words = (text or "").encode().split()  # bytes are split at ASCII white space only
            new = list({w for w in words if w not in self.memo})
            if len(self.memo) + len(new) > MEMO:
                self.memo, new = {}, list(set(words))
            for word, ids in self._encode(new):
                self.memo[word] = struct.pack(f"<{len(ids)}I", *ids)
            yield b"".join(map(self.memo.__getitem__, words)) + self.end


class OpenWindows:
    """Bounded-space best fit: at most ``most`` windows are open; what is closed goes to ``closed``.

    A piece goes to the open window that it fills best. If it fits in none, a window is opened;
    if none may be opened, the fullest one is closed, after its gap took the head of the piece
    where the gap is at least ``min_cut``.
    """

    def __init__(self, window: int, most: int, min_cut: int, closed):
        self.window, self.most, self.min_cut, self.closed = window, most, min_cut, closed
        self.gaps: list[tuple[int, int]] = []  # (gap, window number), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0

    def add(self, doc: tuple, start: int, ids: memoryview) -> None:
        """``ids`` are the ids of document ``doc`` from ``start``, of any length."""
        while len(ids) >= 4 * self.window:
            self.closed([(doc, start, ids[:4 * self.window])])
            start, ids = start + self.window, ids[4 * self.window:]
        while n := len(ids) // 4:
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
            elif len(self.gaps) < self.most:
                self.made += 1
                gap, number = self.window, self.made
                self.pieces[number] = []
            else:
                gap, number = self.gaps.pop(0)
                if gap >= self.min_cut:
                    self.pieces[number].append((doc, start, ids[:4 * gap]))
                    start, ids = start + gap, ids[4 * gap:]
                self.closed(self.pieces.pop(number))
                continue
            self.pieces[number].append((doc, start, ids))
            if gap == n:
                self.closed(self.pieces.pop(number))
            else:
                insort(self.gaps, (gap - n, number))
            return

    def rest(self) -> list[tuple]:
        """Pieces of the windows still open, fullest window first."""
        return [p for _, number in self.gaps for p in self.pieces[number]]


class _Rows:
    """Rows of closed windows, each window with the next sequence number."""

    def __init__(self, first: int, team: int, keep_ids: bool):
        self.next, self.team, self.keep_ids, self.rows = first, team, keep_ids, []

    def closed(self, pieces: list[tuple]) -> None:
        offset = 0
        for (doc_id, doc_tokens), start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next, offset, self.team, bytes(ids) if self.keep_ids else None))
            offset += n
        self.next += 1

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=COLUMNS)
        out["doc_id"] = out["doc_id"].astype("Int64")
        self.rows = []
        return out


def _pack_partition(path: str, end_id: int, window: int, most: int, min_cut: int, fan_in: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode, rows = WordIds(path, end_id), _Rows(part << 32, part // fan_in, keep_ids)
        open_windows = OpenWindows(window, most, min_cut, rows.closed)
        for batch in batches:
            ids = (None if pd.isna(i) else int(i) for i in batch["doc_id"])
            for doc_id, found in zip(ids, encode(batch["text"])):
                open_windows.add((doc_id, len(found) // 4), 0, memoryview(found))
                if len(rows.rows) >= 4096:
                    yield rows.frame()
        yield rows.frame()
        # what is left goes on with its ids and without a sequence
        for (doc_id, doc_tokens), start, ids in open_windows.rest():
            rows.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, None, None, part // fan_in, bytes(ids)))
        out = rows.frame()
        out[["sequence_id", "offset"]] = out[["sequence_id", "offset"]].astype("Int64")
        yield out

    return run


def _merge_team(window: int, most: int, min_cut: int, keep_ids: bool):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        team = int(pieces["team"].iloc[0])
        rows = _Rows((2**30 + team) << 32, team, keep_ids)
        open_windows = OpenWindows(window, most, min_cut, rows.closed)
        for doc_id, tokens, start, ids in zip(pieces["doc_id"], pieces["doc_tokens"], pieces["start"], pieces["ids"]):
            open_windows.add((None if pd.isna(doc_id) else int(doc_id), int(tokens)), int(start), memoryview(ids))
        # the last open windows are chained and cut: whole windows, then powers of two
        left = open_windows.rest()
        room = sum(len(p[2]) // 4 for p in left)
        current, size, target = [], 0, min(window, 1 << max(room.bit_length() - 1, 0))
        for doc, start, ids in left:
            while ids:
                take = min(len(ids) // 4, target - size)
                current.append((doc, start, ids[:4 * take]))
                start, ids, size = start + take, ids[4 * take:], size + take
                if size == target:
                    rows.closed(current)
                    room -= size
                    current, size, target = [], 0, min(window, 1 << max(room.bit_length() - 1, 0))
        return rows.frame()

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN,
    min_cut: int = MIN_CUT, fan_in: int = FAN_IN, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens; with their ids if asked for.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Each
    partition packs what it reads with ``open_windows`` open windows: whole windows are cut off
    long documents, the rest is placed best-fit, and the fullest window is closed when nothing
    fits. Windows still open at the end are merged, ``fan_in`` partitions to a task, so the
    merge grows in tasks and not in size. There the last windows are chained and cut into whole
    windows and powers of two, which need no padding. All windows are powers of two or nearly
    full: less than ``min_cut`` tokens of padding.

    ``window`` is a power of two. Null or empty text is the end id alone. Repeated rows and null
    ids are packed as rows of their own; other columns are ignored; an empty table gives no
    pieces. The first phase is stored once, so a lost executor cannot mix two packings.
    """
    first = stored(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
            _pack_partition(tokenizer, end_id, window, open_windows, min_cut, fan_in, with_ids), PIECES
        ), "packed",
    )
    merged = first.filter("sequence_id is null").groupBy("team").applyInPandas(_merge_team(window, 4 * open_windows, min_cut, with_ids), PIECES)
    return first.filter("sequence_id is not null").unionByName(merged).drop("team", *([] if with_ids else ["ids"]))
