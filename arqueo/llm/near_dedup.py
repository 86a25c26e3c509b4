"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import by_merge, packed, stored, unpacked
from arqueo.llm.components import components

SLOTS = 211  # prime: an element's ranks are a walk through all slots
ROWS = 5
BANDS = SLOTS // ROWS  # a pair at 0.8 is missed by all bands with a chance of 6e-8
FRACTION = np.uint64(24)
MEMO = 500_000
CROWD = 32  # classes in a bucket up to which its pairs are joined
BLOCK = 256  # classes of a crowd that meet in one task
SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, class binary, bands array<bigint>"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(ids))
    rolled = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - size + 1 + k]
    return np.unique(_mix(rolled + np.uint64(size)))


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of hashed elements.

    An element visits the slots in an order of its own (start and stride from its hash, the
    number of slots being prime); at its j-th visit it offers j plus a fraction. So its ranks
    over the slots are a permutation, not independent draws, which lowers the variance. All
    elements go step by step, and stop early when every slot holds less than the next step
    could offer: large sets need one or two steps.
    """
    out = np.full(slots, np.iinfo(np.uint32).max, np.uint32)
    start = (elements % np.uint64(slots)).astype(np.int64)
    stride = (np.uint64(1) + (elements >> np.uint64(32)) % np.uint64(slots - 1)).astype(np.int64)
    for j in range(slots if len(elements) else 0):
        fraction = _mix(elements + np.uint64((j + 1) * 0x632BE59BD9B4E019 % 2**64)) >> (np.uint64(64) - FRACTION)
        offer = (np.uint64(j << int(FRACTION)) + fraction).astype(np.uint32)
        np.minimum.at(out, (start + j * stride) % slots, offer)
        if out.max() < (j + 1) << int(FRACTION):
            break
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    parts = signatures[:, :BANDS * ROWS].astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                sets = [shingle_set(t, size, hashes) for t in part["text"]]
                keys = band_keys(np.array([super_minhash(s) for s in sets]))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(), "text_hash": part["text_hash"].to_numpy(),
                    "n_shingles": [len(s) for s in sets], "class": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "bands": list(keys),
                })

    return run


def _confirm(size: int, percent: int):
    """Pairs whose sets share at least ``percent`` of their union."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, known = WordHashes(), None, None
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (a, x, y) in enumerate(zip(batch["a"], batch["text_a"], batch["text_b"])):
                if a != last:
                    last, known = a, shingle_set(x, size, hashes)
                other = shingle_set(y, size, hashes)
                shared = len(np.intersect1d(known, other, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(known) + len(other) - shared)
            yield batch.loc[good, ["a", "b"]]

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) joined with both texts and checked; joins that adaptive execution can split."""
    both = by_merge(pairs).join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").join(
        by_merge(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))), "a"
    )
    return stored(both.select("a", "b", "text_a", "text_b").mapInPandas(_confirm(size, percent), "a binary, b binary"), "links")


def _with_roots(pairs: DataFrame, roots: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A root_<c> for each class column <c>; a class without links is its own root."""
    for c in columns:
        of = roots.select(F.col("node").alias(c), F.col("root").alias("found"))
        pairs = pairs.join(by_merge(of), c, "left").withColumn(f"root_{c}", F.coalesce("found", c)).drop("found")
    return pairs


def _still_open(rooted: DataFrame) -> DataFrame:
    """Members of the buckets whose classes are in more than one component, with the bucket's size."""
    buckets = rooted.groupBy("key").agg(
        F.min("root_class").alias("low"), F.max("root_class").alias("high"), F.count(F.lit(1)).alias("size")
    ).filter("low != high").select("key", "size")
    return rooted.join(by_merge(buckets), "key")


def _crowds(left: DataFrame) -> DataFrame:
    """(class, root_class, crowd): classes of open buckets above ``CROWD``, buckets that overlap being one crowd.

    Every class is in one crowd, however many of its buckets are large.
    """
    large = left.filter(F.col("size") > CROWD)
    heads = large.groupBy("key").agg(F.min("class").alias("b"))
    found = components(large.join(by_merge(heads), "key").select(F.col("class").alias("a"), "b").filter("a != b").distinct())
    return large.select("class", "root_class").distinct().join(
        by_merge(found.select(F.col("node").alias("class"), F.col("root").alias("crowd"))), "class"
    )


def _block_links(size: int, percent: int):
    """Links between different components among the texts of two blocks, as a forest."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        sets = [shingle_set(t, size, hashes) for t in rows["text"]]
        sizes = np.array([len(s) for s in sets])
        every, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # a shingle of one text adds to no intersection
        shared = count[column] > 1
        place = np.cumsum(count > 1) - 1
        owner, column = owner[shared], place[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int((count > 1).sum()), 16_384):
            lo, hi = np.searchsorted(column, [start, start + 16_384])
            present = np.zeros((len(sets), min(16_384, int((count > 1).sum()) - start)), np.float32)
            present[owner[lo:hi], column[lo:hi] - start] = 1
            both += present @ present.T
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        roots = rows["root_class"].map(bytes).to_numpy()
        classes, parent = rows["class"].map(bytes).to_numpy(), {r: r for r in roots}

        def find(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            p, q = find(roots[i]), find(roots[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((classes[i], classes[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _in_blocks(crowds: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components of a crowd: blocks of bounded size meet pairwise, each pair of blocks a task of its own.

    The largest component of a crowd is not compared with itself. Only links leave a task. The
    rows sent are a crowd's classes times its blocks, not its pairs.
    """
    parts = crowds.groupBy("crowd", "root_class").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("crowd").agg(F.max(F.struct("n", "root_class")).alias("main"), F.sum("n").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sized = crowds.join(by_merge(whole), "crowd").withColumns({
        "is_main": F.col("root_class") == F.col("main.root_class"), "mains": blocks(F.col("main.n")), "others": blocks(F.col("all") - F.col("main.n")),
    }).withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    unit = lambda kind, u, v: F.struct(F.lit(kind).alias("kind"), u.cast("int").alias("u"), v.cast("int").alias("v"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.col("block")
    units = F.when(F.col("is_main"), F.transform(upto("others"), lambda u: unit("main", u, block))).otherwise(F.concat(
        F.transform(upto("others"), lambda v: unit("other", F.least(block, v), F.greatest(block, v))),
        F.transform(upto("mains"), lambda v: unit("main", block, v)),
    ))
    dealt = sized.select("crowd", "class", "root_class", F.explode(units).alias("unit")).join(by_merge(texts), "class")
    found = dealt.groupBy("crowd", "unit").applyInPandas(
        lambda rows: _block_links(size, percent)(rows), "a binary, b binary"
    )
    return stored(found, "block_links")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with n_shingles, component_id and kept.

    Documents are linked if their sets of distinct ``shingle_words``-word shingles share at least
    ``percent`` % of their union; component_id is the smallest doc_id reachable, and kept marks it.

    Documents with equal sets are one class before anything else, so exact copies cost no pairs.
    Classes that share a band key are candidates, and links are confirmed on full sets. A large
    bucket does not emit its pairs: (1) each class is compared with the first class of the
    bucket it shares most often, (2) with the first classes of its other buckets that are not
    in its component by then, (3) classes of one bucket that are still in different components
    are compared with each other: inside tasks, block by block, where buckets are large, and as
    pairs where at most 32 classes share one. Links inside a component change nothing, so the
    components are those of all pairs in all buckets.

    Texts with fewer words than a shingle are one shingle; without words or text, n_shingles is
    0 and the document is linked with nothing. Rows with a null doc_id take part; their
    component_id is the smallest id that is not null, or null. Repeated rows are one document.
    An empty table gives an empty result. No join sends a side through the driver: all sides grow
    with the documents, and staged ones are far smaller as files than as rows.
    """
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    signed = stored(whole.mapInPandas(_sign(shingle_words), SIGNED), "signed")
    classes = stored(
        signed.filter("n_shingles > 0").groupBy("class").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ), "classes",
    )
    keyed = classes.select("class", "n", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("class", "n")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    members = stored(keyed.join(by_merge(heads), "key"), "members")
    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    stars = stored(
        members.filter(F.col("class") != F.col("head.class")).filter(alike(F.col("n"), F.col("head.n")))
        .groupBy(F.col("head.class").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("votes")), "stars",
    )
    needed = members.select("class").distinct().join(by_merge(classes.select("class", "sample.*")), "class")
    texts = stored(
        by_merge(needed).join(whole.withColumnRenamed("doc_id", "id"), ["text_hash"]).filter(F.col("doc_id").eqNullSafe(F.col("id")))
        .select("class", "text").dropDuplicates(["class"]), "texts",
    )
    most = Window.partitionBy("b").orderBy(F.col("votes").desc(), "a")
    ranked = stars.withColumn("nth", F.row_number().over(most))
    links = _confirmed(ranked.filter("nth = 1"), texts, shingle_words, percent)
    roots = components(links)
    others = _with_roots(ranked.filter("nth > 1").select("a", "b"), roots, ("a", "b")).filter("root_a != root_b")
    links = links.unionByName(_confirmed(others.select("a", "b"), texts, shingle_words, percent))
    roots = components(links)

    rooted = stored(_with_roots(members.select("key", "n", "class"), roots, ("class",)), "rooted")
    left = stored(_still_open(rooted), "open")
    grouped = stored(_crowds(left), "crowds")
    links = links.unionByName(_in_blocks(grouped, texts, shingle_words, percent))
    placed = stored(left.join(by_merge(grouped.select("class", "crowd")), "class", "left"), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    apart = F.coalesce(F.col("x.crowd") != F.col("y.crowd"), F.lit(True))
    # buckets of a crowd have been dealt with; in the others a class has few partners
    rest = x.filter(F.col("size") <= CROWD).join(
        by_merge(y), (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.root_class") != F.col("y.root_class"))
        & apart & alike(F.col("x.n"), F.col("y.n"))
    ).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    untested = rest.join(by_merge(stars.select("a", "b")), ["a", "b"], "left_anti")
    links = links.unionByName(_confirmed(untested, texts, shingle_words, percent))
    roots = components(links)

    named = _with_roots(classes.select("class", "sample.doc_id"), roots, ("class",))
    smallest = named.groupBy("root_class").agg(F.min("doc_id").alias("component_id"))
    found = named.select("class", "root_class").join(by_merge(smallest), "root_class").select("class", "component_id")
    judged = signed.select("doc_id", "text_hash", "n_shingles", "class").distinct().join(by_merge(found), "class", "left").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    own = packed(docs, doc_id=F.col("doc_id").cast("bigint"), text_hash=F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    return unpacked(
        own.join(by_merge(judged), same, "left"), n_shingles=F.col("n_shingles"), component_id=F.col("component_id"),
        kept=F.col("doc_id").eqNullSafe(F.col("component_id")),
    )
