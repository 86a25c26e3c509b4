"""Vector codes: the parts of vectors are numbered by codebooks, met through a trie over the distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.functions.numeric import fail_when
from arqueo.llm.common import packed, stored, unpacked
from arqueo.operators.staging import broadcast_if_small, join_same
from arqueo.schema import ContractError

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 65_536  # vectors whose distinct parts make one trie
SUBTREE = 4_096  # distinct parts below a node from which on it is walked level by level
LARGEST = 2**24  # components are smaller, so sums of squares and of a block's values are exact


def nearest_entries(parts: np.ndarray, book: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for each of the sorted distinct ``parts``.

    The parts are the leaves of a trie whose levels are the dimensions. A node holds, for every
    entry, the squared distance accumulated over its prefix; a child adds one dimension to its
    parent's, so parts with a common prefix share that work. Nodes are visited depth first:
    memory is one vector per level and, once a node has at most ``subtree`` leaves, one per
    distinct prefix below it. A leaf takes the smallest distance, ties go to the lower index.
    """
    count, width = parts.shape
    index, distance = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    # the dimension in which a part first differs from the one before it
    differs = np.ones((count, width), dtype=bool)
    differs[1:] = parts[1:] != parts[:-1]
    first = differs.argmax(axis=1) if width else np.zeros(count, dtype=np.int64)

    def leaves(rows: slice, reached: np.ndarray) -> None:
        index[rows] = reached.argmin(axis=1)
        distance[rows] = np.take_along_axis(reached, index[rows][:, None], axis=1)[:, 0]

    def children(low: int, high: int, level: int) -> np.ndarray:
        """Where new prefixes of ``level + 1`` dimensions begin."""
        fresh = first[low:high] <= level
        fresh[0] = True
        return low + np.flatnonzero(fresh)

    waiting = [(0, count, 0, np.zeros(len(book), dtype=np.int64))]
    while waiting:
        low, high, level, reached = waiting.pop()
        if high - low <= subtree:
            # starts[i] is the first leaf of the i-th prefix, reached[i] its accumulated distances
            starts, reached = np.array([low]), reached[None, :]
            for depth in range(level, width):
                deeper = children(low, high, depth)
                parent = np.searchsorted(starts, deeper, side="right") - 1
                reached = reached[parent] + (parts[deeper, depth][:, None] - book[None, :, depth]) ** 2
                starts = deeper
            leaves(slice(low, high), np.broadcast_to(reached, (high - low, len(book))))
            continue
        starts = children(low, high, level)
        ends = np.append(starts[1:], high)
        for a, b in zip(starts[::-1], ends[::-1]):
            waiting.append((a, b, level + 1, reached + (parts[a, level] - book[:, level]) ** 2))
    return index, distance


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0]:offsets[-1]].reshape(len(lists), width)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``block`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= block:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _partial_sums(books: np.ndarray, block: int):
    """Per task: how many parts each entry takes, and their sums, for every part position."""
    places, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((places, entries), dtype=np.int64)
        sums = np.zeros((places, entries, width), dtype=np.int64)
        for some in _blocks(batches, block):
            values = _matrix(some.column("ints"), places * width)
            for p in range(places):
                parts, weight = np.unique(values[:, p * width:(p + 1) * width], axis=0, return_counts=True)
                index, _ = nearest_entries(parts, books[p])
                np.add.at(counts[p], index, weight)
                np.add.at(sums[p], index, parts * weight[:, None])
        place, entry = np.nonzero(counts)
        yield pa.record_batch({
            "place": pa.array(place, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[place, entry], pa.int64()),
            "sums": pa.array(list(sums[place, entry]), pa.list_(pa.int64())),
        })

    return run


def _encode(books: np.ndarray, block: int):
    places, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _blocks(batches, block):
            values = _matrix(some.column("ints"), places * width)
            code, error = np.empty((len(values), places), dtype=np.uint8), np.zeros(len(values), dtype=np.int64)
            for p in range(places):
                parts, leaf = np.unique(values[:, p * width:(p + 1) * width], axis=0, return_inverse=True)
                index, distance = nearest_entries(parts, books[p])
                code[:, p], error = index[leaf.ravel()], error + distance[leaf.ravel()]
            yield pa.RecordBatch.from_arrays(
                [some.column("row"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["row", "code", "error"]
            )

    return run


def _ints(vector: Column) -> Column:
    """floor(256 x) of every component; null if the vector or a component is null or no finite number."""
    there = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(there, F.lit(False)), F.transform(
        vector, lambda x: fail_when(F.abs(x) * SCALE >= LARGEST, "a component is too large for exact sums", F.floor(x * SCALE).cast("bigint"))
    ))


def _first_books(kept: DataFrame, places: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids; of equal ids the smaller vector first, null ids last."""
    first = kept.select("id", "ints").orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    if not first:
        return np.zeros((places, 0, 0), dtype=np.int64)
    if len({len(r["ints"]) for r in first}) > 1:
        raise ContractError("vectors of different lengths")
    values = np.array([r["ints"] for r in first], dtype=np.int64)
    if values.shape[1] % places:
        raise ContractError(f"vectors of {values.shape[1]} components cannot be cut into {places} equal parts")
    return values.reshape(len(first), places, -1).transpose(1, 0, 2).copy()


def train_codebooks(kept: DataFrame, parts: int, entries: int, rounds: int, block: int) -> np.ndarray:
    """(part position, entry, dimension): ``rounds`` rounds of assignment and floored means over all rows of ``ints``."""
    books = _first_books(kept, parts, entries)
    sized = fail_when(F.size("ints") != parts * books.shape[2], "vectors of different lengths", F.col("ints"))
    for _ in range(rounds if books.size else 0):
        partial = kept.select(sized.alias("ints")).mapInArrow(_partial_sums(books, block), "place int, entry int, n bigint, sums array<bigint>")
        width = books.shape[2]
        # at most parts x entries rows
        means = partial.groupBy("place", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        for r in means.collect():
            books[r["place"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows with code (one byte a part) and error, and the codebooks (part, entry, dimension).

    ``vectors`` has vec_id and embedding. Components become floor(256 x); a codebook per part
    position starts from the vectors with the smallest ids and is refined by rounds over all
    rows. A task makes tries over the distinct parts of ``block`` vectors, so copies are met
    once and the memory of a task does not depend on the data. Only counts and sums of entries
    are shuffled, no vector is; the codebooks are all that the driver holds.

    Rows whose vector is null or holds a null or non-finite component are dropped. All others
    must be equally long and cut into ``parts``; else, and for components of 65,536 or more,
    the job stops. With fewer rows than ``entries`` there are as many entries as rows. Repeated
    rows and null ids stay; rows of equal ids count by their vectors. An empty table gives an
    empty table and no codebooks. ``entries`` is at most 256. Columns called code or error are replaced.
    """
    if not 1 <= entries <= 256:
        raise ContractError("entries must lie between 1 and 256")
    kept = stored(
        packed(vectors, id=F.col("vec_id"), ints=_ints(F.col("embedding"))).filter(F.col("ints").isNotNull()), "vectors"
    )
    books = train_codebooks(kept, parts, entries, rounds, block)
    coded = kept.select("row", "ints").mapInArrow(
        _encode(books, block), T.StructType([kept.schema["row"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    ) if books.size else kept.select("row", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error"))
    return unpacked(coded, code=F.col("code"), error=F.col("error")), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Every row with ``label_error``, the sum of error over its label (null labels together).

    The sums are stored first: then they are broadcast if they are few, and else a label with
    many rows can be split by the adaptive join, as both sides come straight from an exchange.
    """
    rows = stored(packed(coded, label=F.col(label), error=F.col("error")), "coded")
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    return unpacked(join_same(rows, broadcast_if_small(sums), ["label"]), label_error=F.col("label_error"))
