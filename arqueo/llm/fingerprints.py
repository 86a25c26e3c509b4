"""Document fingerprints: content-defined chunks, and how much of one text another contains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import packed, stored, unpacked

LEAST, NORMAL, MOST = 16, 64, 256  # code points in a chunk
EARLY_BITS, LATE_BITS = 7, 5  # zero bits that end a chunk before and after its normal size
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A multiplicative mix of code points to 32 bits: the gear table, for any code point."""
    x = (x + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


GEAR = _mixed(np.arange(65_536, dtype=np.uint32))


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """The gear hash at every code point: sum of gear values of the last 32, each shifted by its age."""
    gears = GEAR[points] if not len(points) or points.max() < 65_536 else _mixed(points)
    out, step = gears.copy(), 1
    while step < 32 and step < len(out):
        # out[i] covers `step` points: doubling needs the sum that ended `step` points before
        longer = out.copy()
        longer[step:] += out[:-step] << np.uint32(step)
        out, step = longer, 2 * step
    return out


def chunk_ends(points: np.ndarray) -> list[int]:
    """Ends of the chunks of one text: rarer boundaries before the normal size, more frequent ones after."""
    n = len(points)
    if n <= LEAST:
        return [n] if n else []
    hashes = gear_hashes(points)
    late = np.flatnonzero(hashes >> np.uint32(32 - LATE_BITS) == 0) + 1
    is_early = (hashes[late - 1] >> np.uint32(32 - EARLY_BITS)) == 0
    ends, at, i, late, is_early = [], 0, 0, late.tolist(), is_early.tolist()
    total = len(late)
    while at < n:
        least, normal, most = at + LEAST, at + NORMAL, min(at + MOST, n)
        while i < total and late[i] < least:
            i += 1
        end = most
        while i < total and late[i] <= most:
            if late[i] >= normal or is_early[i]:
                end = late[i]
                break
            i += 1
        ends.append(end)
        at = end
    return ends


def chunks(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, digest) of every chunk, in code points."""
    data = (text or "").encode("utf-32-le", "surrogatepass")
    view, start, out = memoryview(data), 0, []
    for end in chunk_ends(np.frombuffer(data, np.uint32)):
        out.append((start, end, xxhash.xxh3_64_intdigest(view[4 * start:4 * end])))
        start = end
    return out


def fingerprint_set(text: str | None) -> dict[int, int]:
    """Length of each distinct chunk by the 48 bits that are kept of its digest."""
    return {digest >> 16: end - start for start, end, digest in chunks(text)}


def _digits(number: int, count: int) -> str:
    return "".join(ALPHABET[(number >> (6 * k)) & 63] for k in range(count))


def written(chunk_lengths: dict[int, int]) -> str:
    """A fingerprint as text: ten characters a chunk, eight of digest and two of length, sorted."""
    pairs = [ALPHABET[a] + ALPHABET[b] for b in range(64) for a in range(64)] if not _PAIRS else _PAIRS
    if not _PAIRS:
        _PAIRS.extend(pairs)
    return "".join([
        pairs[d & 4095] + pairs[d >> 12 & 4095] + pairs[d >> 24 & 4095] + pairs[d >> 36] + pairs[n]
        for d, n in sorted(chunk_lengths.items())
    ])


_PAIRS: list[str] = []
VALUE = {c: i for i, c in enumerate(ALPHABET)}


def parsed(fingerprint: str) -> dict[str, int]:
    return {
        fingerprint[i:i + 8]: VALUE[fingerprint[i + 8]] + 64 * VALUE[fingerprint[i + 9]] for i in range(0, len(fingerprint), 10)
    }


def containment_of(part: dict, whole: dict) -> float:
    """Share of ``part``'s chunk lengths that ``whole`` holds; two empty ones hold each other."""
    if not part:
        return 0.0 if whole else 1.0
    return sum(n for d, n in part.items() if d in whole) / sum(part.values())


def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: written(fingerprint_set(t)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``: the sorted set of chunk digests with their lengths.

    Null or empty text has an empty fingerprint. Equal texts have equal ones.
    """
    of = F.pandas_udf(_fingerprints, "string")
    return unpacked(packed(docs), fingerprint=of(F.coalesce(F.col("row.text"), F.lit(""))))


def chunk_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end and digest of every chunk, in code points; null or empty text has none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s, e, d - 2**63) for i, text in zip(batch["doc_id"], batch["text"]) for s, e, d in chunks(text)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "digest"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id bigint, start bigint, end bigint, digest bigint")


def containment(part: Column, whole: Column) -> Column:
    """Share of one fingerprint that another holds, weighted by chunk length (0 to 1)."""
    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([containment_of(parsed(x or ""), parsed(y or "")) for x, y in zip(a, b)])

    return share(part, whole)


def edited(text: str, other: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``other``."""
    k = len(text) // 4
    return text[:len(text) - k] + other[:k]


COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def _compare(doc_id, text: str, own: dict, other: str, others: dict) -> tuple:
    changed = edited(text, other)
    after = fingerprint_set(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(after),
        containment_of(own, after), containment_of(own, others),
    )


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each row with the next of its partition; hands the first and the last row on."""
    part, held, rows = TaskContext.get().partitionId(), None, []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*NAMES, "part", "role", "text"])
        rows.clear()
        return out.astype({"doc_id": "Int64", "n_chars": "Int64", "part": "Int64"})

    empty = (None,) * (len(NAMES) - 1)
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id, marks = None if pd.isna(doc_id) else int(doc_id), fingerprint_set(text)
            if held is None:
                rows.append((doc_id, *empty, part, "head", text))
            else:
                rows.append((*_compare(*held, text, marks), None, None, None))
            held = (doc_id, text, marks)
            if len(rows) >= 1000:
                yield frame()
    if held is not None:
        rows.append((held[0], *empty, part, "tail", held[1]))
    yield frame()


def _at_borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            _compare(None if pd.isna(i) else int(i), text, fingerprint_set(text), other, fingerprint_set(other))
            for i, text, other in zip(batch["doc_id"], batch["text"], batch["other"])
        ]
        yield pd.DataFrame(rows, columns=NAMES).astype({"doc_id": "Int64"})


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The next document is the one of the next higher doc_id, after the last the first. Rows are
    sorted by ranges of ids; each task goes through its range once, in order, holding one row.
    Only the first and last row of a range meet rows of other tasks, through a small join.

    ``near_edited`` and ``near_next`` are containments: the share of the text's chunk lengths
    that the other fingerprint holds. Null text counts as empty; an empty text is held by an
    empty one only. Null ids come last; repeated rows follow each other, ordered by text hash.
    A single row is its own next. An empty table gives an empty result; other columns are ignored.
    """
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    first = stored(ranged.mapInPandas(_in_order, f"{COMPARED}, part bigint, role string, text string"), "compared", "zstd")  # digits of 6 bits each
    # one number per non-empty range
    parts = first.filter("role = 'head'").select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    follows = parts.select("part", following.alias("next"))
    heads = first.filter("role = 'head'").select(F.col("part").alias("next"), F.col("text").alias("other"))
    borders = first.filter("role = 'tail'").select("doc_id", "text", "part").join(follows, "part").join(heads, "next")
    return first.filter("role is null").select(*NAMES).unionByName(borders.select("doc_id", "text", "other").mapInPandas(_at_borders, COMPARED))
