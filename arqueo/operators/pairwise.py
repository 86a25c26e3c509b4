"""Row-against-all-rows computations over vectors, in blocks of bounded size.

Rows are dealt into blocks by a hash of their id, so every block has about the same number
of rows whatever the data. A pair of blocks is one group of an Arrow job: it sees two bounded
blocks and emits *reduced* results (sums, or the best k), never the pairs. Distances are
symmetric, so unordered pairs of blocks are enough where both sides want a result
(``triangular``). Neighbours skip the pairs of blocks that pivots show to be too far apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.operators.staging import written

BLOCK_ROWS = 2_048
PIVOTS = 256
MANY_BLOCKS, LARGER = 24, 4  # with more blocks than this, blocks are up to so many times larger
CHUNK_CELLS = 4_000_000
PRODUCT_CELLS = 500_000  # distances that are at hand at once: as many as a processor keeps close
CLOSE = 1e-3  # squared distances below this part of the squared lengths are taken from differences


def distance_chunks(left: np.ndarray, right: np.ndarray):
    """(first row, distances) for slices of the left rows that fit in memory.

    Differences are taken directly: the dot-product form loses the small distances.
    """
    step = max(1, CHUNK_CELLS // max(1, right.size))
    for start in range(0, len(left), step):
        gap = left[start:start + step, None, :] - right[None, :, :]
        yield start, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))


def pair_squares(left: np.ndarray, right: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Squared distances of the named pairs from their differences, in slices that fit in memory."""
    found, step = np.empty(len(row)), max(1, CHUNK_CELLS // max(1, left.shape[1]))
    for start in range(0, len(row), step):
        part = slice(start, start + step)
        gap = left[row[part]] - right[column[part]]
        found[part] = np.einsum("ij,ij->i", gap, gap)
    return found


def square_chunks(left: np.ndarray, right: np.ndarray, reuse: bool = False):
    """(first row, squared distances, their largest errors by row) for slices of the left rows, from dot products.

    The common centre is taken off first. An error is not a number where a vector is not finite.
    With ``reuse`` the next slice takes the memory of the one before.
    """
    with np.errstate(all="ignore"):
        centre = right.mean(axis=0)
        a, b = left - centre, right - centre
        own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        # rounding of the products, and of taking off the centre
        reach = own + other.max() + np.einsum("i,i->", centre, centre) * 1e-3
        error = reach * ((left.shape[1] + 8) * 8 * np.finfo(float).eps)
        turned = np.ascontiguousarray(b.T) * -2.0
        step = max(1, PRODUCT_CELLS // max(1, len(right)))
        room = np.empty((min(step, len(left)), len(right))) if reuse else None
        for start in range(0, len(left), step):
            part = slice(start, start + step)
            square = np.matmul(a[part], turned, out=room[:len(a[part])]) if reuse else a[part] @ turned
            square += other
            square += own[part, None]
            yield start, square, error[part]


def summed_chunks(left: np.ndarray, right: np.ndarray):
    """Like ``distance_chunks``, for sums of distances: dot products, and differences for close pairs.

    The relative error of a distance is below 1e-9; far pairs, which are most, cost a product of matrices.
    """
    for start, square, error in square_chunks(left, right):
        limit = np.maximum(error[:, None] / ((left.shape[1] + 8) * 8 * np.finfo(float).eps) * CLOSE, 0)
        close = ~(square > limit) | ~np.isfinite(square)
        if close.any():
            row, column = np.nonzero(close)
            square[row, column] = pair_squares(left[start:start + len(square)], right, row, column)
        yield start, np.sqrt(square, out=square)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def block_count(count: int, block_rows: int) -> int:
    """How many blocks ``count`` rows make. Rows are sent once to each block, so many blocks are fewer and larger ones."""
    blocks = max(1, -(-count // block_rows))
    return blocks if blocks <= MANY_BLOCKS else max(MANY_BLOCKS, -(-count // (LARGER * block_rows)))


def _dealt(rows: DataFrame, count: int, block_rows: int) -> tuple[DataFrame, int]:
    blocks = block_count(count, block_rows)
    return rows.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def against(
    left: DataFrame, right: DataFrame, reduce_block: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    block_rows: int = BLOCK_ROWS, counts: tuple[int, int] | None = None,
) -> DataFrame:
    """Apply ``reduce_block`` to every pair of a block of ``left`` and a block of ``right`` (both have ``id``)."""
    n, m = counts or (left.count(), right.count())
    (one, blocks), (two, others) = _dealt(left, n, block_rows), _dealt(right, m, block_rows)
    one = one.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    # fresh column identities: both sides may come from the same plan
    two = two.select(*[F.col(c).alias(c if c != "_block" else "_other") for c in two.columns])
    two = two.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["_block", "_other"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(reduce_block, schema)


def against_all(
    rows: DataFrame, reduce_block: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    block_rows: int = BLOCK_ROWS, count: int | None = None,
) -> DataFrame:
    """Apply ``reduce_block`` to every ordered pair of blocks of ``rows`` (which have ``id``)."""
    n = rows.count() if count is None else count
    return against(rows, rows, reduce_block, schema, block_rows, (n, n))


def triangular(
    rows: DataFrame, reduce_tile: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str,
    block_rows: int = BLOCK_ROWS, count: int | None = None,
) -> DataFrame:
    """Apply ``reduce_tile`` to every unordered pair of blocks: it returns the results of both sides.

    Its last argument tells that the two blocks are the same. Every row is sent once to each
    block, where ``against_all`` sends it twice.
    """
    dealt, blocks = _dealt(rows, rows.count() if count is None else count, block_rows)
    tiled = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
        {"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")}
    )

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        low, high = int(part["_low"].iloc[0]), int(part["_high"].iloc[0])
        first = part[part["_block"] == low]
        return reduce_tile(first, first if low == high else part[part["_block"] == high], low == high)

    return tiled.groupBy("_low", "_high").applyInPandas(tile, schema)


def euclidean(left: Column, right: Column) -> Column:
    """Distance of two array columns, inside the JVM."""
    return F.sqrt(F.aggregate(
        F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    ))


def same_ids(own: np.ndarray, names: np.ndarray):
    """An index of the pairs of equal ids; ``names`` ascend."""
    if own.dtype.kind in "iu" and names.dtype.kind in "iu":
        low, high = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        each = high - low
        row = np.repeat(np.arange(len(own)), each)
        return row, np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return np.nonzero(own[:, None] == names[None, :])


def _best_of(k: int):
    """The k nearest of a block: dot products tell who may be among them, differences and ids tell who is."""
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id", kind="stable")
        ids, names = left["id"].to_numpy(), right["id"].to_numpy()
        parts = []
        if len(left) and len(right):
            one, two = matrix(left["vec"]), matrix(right["vec"])
            # squares that a row's k-th neighbour does not exceed, where they are known
            known = left["bound"].to_numpy() ** 2 if "bound" in left.columns else np.full(len(left), np.inf)
            for start, square, error in square_chunks(one, two):
                part = slice(start, start + len(square))
                own = ids[part]
                square[same_ids(own, names)] = np.inf
                limit = known[part].copy()
                unknown = ~np.isfinite(limit)
                if unknown.any() and k < square.shape[1]:
                    limit[unknown] = np.partition(square[unknown], k - 1, axis=1)[:, k - 1]
                # what is no number may be anything
                may = ~(square > (limit + 4 * error)[:, None])
                may[same_ids(own, names)] = False
                row, column = np.nonzero(may)
                found = np.sqrt(pair_squares(one[part], two, row, column))
                order = np.lexsort((column, found, row))
                row, column, found = row[order], column[order], found[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (place < k) & np.isfinite(found)
                parts.append(pd.DataFrame({"id": own[row[keep]], "vecino": names[column[keep]], "distancia": found[keep]}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": ids[:0], "vecino": ids[:0], "distancia": np.empty(0)})

    return best


def nearest_rows(rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """The k nearest other rows of every row: (id, vecino, distancia, puesto); ties by id.

    ``rows`` has a unique sortable ``id`` and ``vec``. Each block keeps its own best k, so the
    final ranking sees at most k rows per block and id, and loses none of the true k. More than
    one block of rows goes through ``NeighbourSearch``, which skips blocks that cannot matter.
    """
    typed = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    n = typed.count()
    if n <= block_rows:
        candidates = against_all(typed, _best_of(k), f"id {dict(rows.dtypes)['id']}, vecino {dict(rows.dtypes)['id']}, distancia double", block_rows, n)
    else:
        candidates = NeighbourSearch(typed, n, k, block_rows, pivots).candidates()
    place = Window.partitionBy("id").orderBy("distancia", "vecino")
    return candidates.withColumn("puesto", F.row_number().over(place).cast("bigint")).filter(F.col("puesto") <= k)


class NeighbourSearch:
    """Exact nearest neighbours with pivots.

    Pivots are rows of least hash, at most ``pivots`` of them. Every row belongs to its nearest
    pivot; a pivot's rows are dealt into blocks of bounded size, so a dense place is many blocks and
    not one, and small pivots that lie near each other share a block. The k-th distance inside a row's own block bounds its k-th neighbour
    from above. By the triangle inequality no row of pivot p is nearer to x than d(x, p) minus the
    radius of p: a row is only sent to the blocks for which that does not exceed its bound, and
    a block only to those that some row asks for.
    """

    def __init__(self, rows: DataFrame, count: int, k: int, block_rows: int, pivots: int):
        self.k, self.id_type = k, dict(rows.dtypes)["id"]
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, count // 2))).select("vec").collect()
        self.centres = np.unique(np.array([r["vec"] for r in chosen], dtype=float), axis=0)
        centres = self.centres

        def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own, far = np.empty(len(batch), dtype=np.int64), np.empty(len(batch))
                if len(batch):
                    for start, dist in distance_chunks(matrix(batch["vec"]), centres):
                        part = slice(start, start + len(dist))
                        own[part] = dist.argmin(axis=1)
                        far[part] = dist.min(axis=1)
                yield batch.assign(pivot=own.astype(np.int32), far=far)

        cells = written(rows.mapInPandas(owned, f"id {self.id_type}, vec array<double>, pivot int, far double"), "pivot_cells")
        # at most one row per pivot
        stats = {r["pivot"]: r for r in cells.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
        self.radius = np.array([stats[p]["radius"] if p in stats else -np.inf for p in range(len(centres))])
        self.blocks, self.first, self.total = self._packed(
            [stats[p]["n"] if p in stats else 0 for p in range(len(centres))], -(-count // block_count(count, block_rows))
        )
        first = F.element_at(F.array(*[F.lit(int(x)) for x in self.first]), F.col("pivot") + 1)
        many = F.element_at(F.array(*[F.lit(int(x)) for x in np.maximum(self.blocks, 1)]), F.col("pivot") + 1)
        self.cells = cells.select("id", "vec", (first + F.pmod(F.xxhash64("id"), many)).cast("int").alias("block"))

    def _packed(self, sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(blocks of each pivot, its first block, blocks in all); pivots are taken from each to the nearest left."""
        blocks, first = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        left, at, total, room = np.ones(len(sizes), dtype=bool), 0, 0, 0
        for _ in sizes:
            left[at] = False
            if sizes[at] > most:
                blocks[at], first[at] = -(-sizes[at] // most), total
                total, room = total + int(blocks[at]), 0
            elif sizes[at]:
                if sizes[at] > room:
                    total, room = total + 1, most
                blocks[at], first[at], room = 1, total - 1, room - sizes[at]
            far = np.where(left, ((self.centres - self.centres[at]) ** 2).sum(axis=1), np.inf)
            at = int(far.argmin())
        return blocks, first, total

    def wanted(self) -> DataFrame:
        """(id, vec, block, bound, other): every row and the blocks that may hold one of its k nearest."""
        k, centres, radius, blocks, firsts, total = self.k, self.centres, self.radius, self.blocks, self.first, self.total

        def bound(part: pd.DataFrame) -> pd.DataFrame:
            vectors, bounds = matrix(part["vec"]), np.full(len(part), np.inf)
            if len(part) > k:
                for start, square, error in square_chunks(vectors, vectors):
                    # itself is among them, at distance 0
                    far = np.partition(square, k, axis=1)[:, k] + error
                    bounds[start:start + len(square)] = np.where(np.isfinite(far), np.sqrt(np.maximum(far, 0)), np.inf)
            return part.assign(bound=bounds)

        def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                for start, dist in distance_chunks(matrix(batch["vec"]), centres):
                    part = batch.iloc[start:start + len(dist)]
                    limit = part["bound"].to_numpy()[:, None]
                    # rounding may not lose a row that lies exactly on its bound
                    row, pivot = np.nonzero((dist - radius[None, :] <= limit * (1 + 1e-9) + 1e-12) & (blocks > 0)[None, :])
                    each = blocks[pivot]
                    other = np.repeat(firsts[pivot], each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
                    # pivots that share a block ask for it once
                    row, other = np.divmod(np.unique(np.repeat(row, each) * total + other), total)
                    yield part.iloc[row].assign(other=other.astype(np.int32))

        kind = f"id {self.id_type}, vec array<double>, block int"
        bounded = self.cells.groupBy("block").applyInPandas(bound, f"{kind}, bound double")
        return written(bounded.mapInPandas(asking, f"{kind}, bound double, other int"), "asking_rows")

    def candidates(self) -> DataFrame:
        """At most k rows (id, vecino, distancia) of each block that a row was sent to."""
        wanted = self.wanted()
        pairs = written(wanted.select("block", "other").distinct(), "block_pairs")
        asked = self.cells.withColumnRenamed("block", "_at").join(pairs, F.col("_at") == F.col("other")).select("block", "other", "id", "vec")
        keys = ["block", "other"]
        return wanted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
            _best_of(self.k), f"id {self.id_type}, vecino {self.id_type}, distancia double"
        )


def silhouette_cuts(rows: DataFrame, block_rows: int = BLOCK_ROWS, count: int | None = None) -> DataFrame:
    """Euclidean silhouettes of every row under several labellings: (id, corte, label, silhouette); singletons get 0.

    ``rows`` has a unique ``id``, ``vec`` and ``labels``, an array with one label per labelling;
    ``corte`` is the position in it. The distances of a pair of blocks are computed once for all
    labellings and for both blocks. Tiles emit one list of distance sums per (row, labelling), a sum
    for each label in the other block, so labels of any size are handled alike.
    """
    types = dict(rows.dtypes)
    label_type = types["labels"].removeprefix("array<").removesuffix(">")

    def sums(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        sides = [(a, b)] if same else [(a, b), (b, a)]
        own = [np.array(x["labels"].tolist(), dtype=object).reshape(len(x), -1) for x in (a, b)]
        cuts = own[0].shape[1]
        coded = [[np.unique(own[side][:, c], return_inverse=True) for c in range(cuts)] for side in (0, 1)]
        member = [[np.eye(len(names))[code] for names, code in coded[side]] for side in (0, 1)]
        # [side][cut]: distance sums of the rows of that side to the labels of the other one
        total = [[np.zeros((len(own[side]), len(coded[1 - side][c][0]))) for c in range(cuts)] for side in (0, 1)]
        for start, dist in summed_chunks(matrix(a["vec"]), matrix(b["vec"])):
            part = slice(start, start + len(dist))
            for c in range(cuts):
                total[0][c][part] = dist @ member[1][c]
                if not same:
                    total[1][c] += dist.T @ member[0][c][part]
        out = []
        for side, (rows_here, _) in enumerate(sides):
            ids = rows_here["id"].to_numpy()
            for c in range(cuts):
                names, code = coded[1 - side][c]
                members = np.bincount(code, minlength=len(names))
                out.append(pd.DataFrame({
                    "id": ids, "corte": np.int32(c), "label": own[side][:, c], "others": [names] * len(ids),
                    "distances": list(total[side][c]), "sizes": [members] * len(ids),
                }))
        return pd.concat(out)

    def tile(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("id", "corte", "label", "others", "distances", "sizes")})
        return sums(a, b, same)

    partial = triangular(
        rows.select("id", F.col("vec").cast("array<double>").alias("vec"), "labels"), tile,
        f"id {types['id']}, corte int, label {label_type}, others array<{label_type}>, distances array<double>, sizes array<bigint>", block_rows, count,
    )
    # a row's lists come together before they are opened, so they are shuffled as they are
    each = partial.repartition("id").select("id", "corte", "label", F.inline(F.arrays_zip(
        F.col("others").alias("other"), F.col("distances").alias("distance"), F.col("sizes").alias("n"))))
    per_label = each.groupBy("id", "corte", "label", "other").agg(F.sum("distance").alias("distance"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    per_row = per_label.groupBy("id", "corte", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("distance") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("distance") / F.col("n"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (widest == 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / F.when(widest != 0, widest)
    )
    return per_row.select("id", "corte", "label", value.alias("silhouette"))


def silhouette_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Euclidean silhouette of every row under one labelling: (id, label, silhouette); singletons get 0."""
    one = rows.select("id", "vec", F.array("label").alias("labels"))
    return silhouette_cuts(one, block_rows).select("id", "label", "silhouette")


def squared_silhouette_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The variant on *squared* distances, from per-label sums: another number, linear in the rows for few labels.

    Rows meet the statistics of all labels in blocks, so neither side has a bound.
    """
    types = dict(rows.dtypes)
    typed = rows.select("id", F.col("vec").cast("array<double>").alias("vec"), "label")
    stats = written(label_centroids(typed).withColumn("id", F.xxhash64("label")), "label_stats")

    def mean_squares(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"id": left["id"][:0], "label": left["label"][:0], "own": [], "n": [], "other": []})]
        if len(left) and len(right):
            names, n, spread = right["label"].to_numpy(), right["n"].to_numpy(), right["spread"].to_numpy()
            for start, dist in distance_chunks(matrix(left["vec"]), matrix(right["centroid"])):
                part = left.iloc[start:start + len(dist)]
                square = dist ** 2 + spread[None, :]
                mine = part["label"].to_numpy()[:, None] == names[None, :]
                here = mine.any(axis=1)
                parts.append(pd.DataFrame({
                    "id": part["id"].to_numpy(), "label": part["label"].to_numpy(),
                    "own": np.where(here, np.where(mine, square, 0.0).sum(axis=1), np.nan), "n": np.where(here, np.where(mine, n, 0).sum(axis=1), 0),
                    "other": np.where(mine, np.inf, square).min(axis=1),
                }))
        return pd.concat(parts)

    found = against(typed, stats, mean_squares, f"id {types['id']}, label {types['label']}, own double, n bigint, other double", block_rows)
    # one row per block of labels, and one of them has the row's own label
    whole = found.groupBy("id", "label").agg(
        F.max(F.when(F.col("n") > 0, F.col("own"))).alias("own"), F.max("n").alias("n"), F.min("other").alias("b")
    )
    a = F.col("own") * F.col("n") / (F.col("n") - 1)
    lonely = (F.col("n") <= 1) | (F.col("b") == float("inf"))
    value = F.when(lonely, 0.0).otherwise((F.col("b") - a) / F.greatest(a, "b"))
    return whole.select("id", "label", value.alias("silhouette"))


def label_centroids(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per label (of each ``by``): members, centroid, and mean squared distance to it (``spread``).

    One vector aggregate with partial sums: a label that holds a large part of the rows is
    reduced where its rows are.
    """
    vector = array_to_vector(F.col("vec").cast("array<double>"))
    moments = rows.groupBy(*by, "label").agg(
        Summarizer.metrics("mean", "variance", "count").summary(vector).alias("_s")
    )
    # the summary gives sample variances; the spread is over all members
    variance = F.aggregate(vector_to_array("_s.variance"), F.lit(0.0), lambda s, x: s + x)
    return moments.select(
        *by, "label", F.col("_s.count").alias("n"), vector_to_array("_s.mean").alias("centroid"),
        (variance * (F.col("_s.count") - 1) / F.col("_s.count")).alias("spread"),
    )
