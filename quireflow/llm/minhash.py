"""Near-duplicate documents by circulant MinHash.

Two permutations of a universe of 2**22 make the whole signature: the first one scatters shingle hashes, the second
one, shifted circularly by k, gives coordinate k. So the K coordinates of a shingle are K neighbours in one table,
and a document's signature is the elementwise minimum of such runs.

The flow, where no step holds a group's rows together or emits its pairs:

1. Equal shingle sets collapse to their smallest doc_id, by a fingerprint of 128 bits.
2. Signatures are cut into bands; a bucket's members are linked to its smallest member once both full sets confirm it. A
   document is first held against the smallest of its buckets' smallest members, then only against those it isn't linked to yet.
3. Buckets that still hold several components go on. In a bucket of at most SMALL members, pairs across components
   are compared. Larger buckets that overlap form clusters, whose rows are dealt into blocks of about BLOCK documents
   or BLOCK_SHINGLES shingles, whichever is less; block pairs are compared by products of 0/1 matrices. Pairs within one component need no comparison, they are linked.
4. Components again, then every copy takes its representative's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, shingle_sets, short_batches, sieved, staged
from .components import components, extended

#: Bands and coordinates in each: a pair of similarity 0.8 shares no band with a probability of 3e-6.
BANDS, ROWS = 32, 5
UNIVERSE_BITS = 22
SMALL, BLOCK, BLOCK_SHINGLES = 32, 256, 1 << 18
#: Columns of the 0/1 matrices that are multiplied at once.
COLUMNS = 1 << 14

_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def permutations(coordinates: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the circulant one followed by its own beginning."""
    if (coordinates, seed) not in _TABLES:
        rng = np.random.default_rng(seed)
        scatter = rng.permutation(1 << UNIVERSE_BITS).astype(np.int32)
        values = rng.permutation(1 << UNIVERSE_BITS).astype(np.int32)
        _TABLES[coordinates, seed] = scatter, np.concatenate([values, values[:coordinates]])
    return _TABLES[coordinates, seed]


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS, seed: int = 7) -> np.ndarray:
    scatter, values = permutations(coordinates, seed)
    at = scatter[(hashes & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    runs = np.lib.stride_tricks.sliding_window_view(values, coordinates)
    least = np.full(coordinates, 1 << UNIVERSE_BITS, np.int32)
    for k in range(0, len(at), 2048):
        np.minimum(least, runs[at[k : k + 2048]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal bands have equal keys."""
    cut = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
        for k in range(rows):
            key = mixed(key + cut[:, :, k])
    return key.view(np.int64)


def alike(inter: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in shingle_sets(batch.column(1), width):
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                f1, f2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                with np.errstate(over="ignore"):
                    for i in full:
                        f1[i] = mixed(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
                        f2[i] = mixed(sets[i] + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)
                keys = band_keys(np.stack([signature(sets[i], bands * rows) for i in full]), bands, rows) if len(full) else np.zeros((0, bands), np.int64)
                ends = np.cumsum(np.where(sizes > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(f1), pa.array(f2), lists], names=["id", "n", "f1", "f2", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike. Each pair brings its own two texts; nothing is grouped, and other texts aren't moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 32):  # two sets for each pair, of texts of any length
                part = batch.slice(k, 32)
                left, right = ([s for _, _, sets in shingle_sets(part.column(c), width) for s in sets] for c in (2, 3))
                keep = [alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent) for x, y in zip(left, right, strict=True)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = staged(pairs, "pairs")
    one, two = (sieved(texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")), c, pairs.select(c)).filter("__maybe").drop("__maybe") for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sides aren't in one component of found (v, comp); the others are linked already."""
    one, two = found.select(F.col("v").alias("a"), F.col("comp").alias("ca")), found.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs that hold together what all pairs do, one less than the members of each component at most."""
    home: dict[int, int] = {}

    def root(x: int) -> int:
        while home.setdefault(x, x) != x:
            home[x] = x = home[home[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            home[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def block_links(part: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """Links across components in a pair of blocks or in one block: of all that hold, as many as keep the same components."""
    sets = [s for _, _, found in shingle_sets(pa.array(part["text"], pa.string()), width) for s in found]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(df), -1)
    rank[df > 1] = np.arange((df > 1).sum())  # a shingle of one document is in no intersection
    col, row = rank[code], np.repeat(np.arange(len(sets)), sizes)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for first in range(0, int((df > 1).sum()), COLUMNS):
        a, b = np.searchsorted(col, [first, first + COLUMNS])
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[row[a:b], col[a:b] - first] = 1
        shared += ones @ ones.T
    inter = np.rint(shared).astype(np.int64)
    ids, comp = part["id"].to_numpy(), part["comp"].to_numpy()
    good = alike(inter, sizes[:, None], sizes[None, :], percent) & (comp[:, None] != comp[None, :]) & (ids[:, None] < ids[None, :])
    i, j = np.nonzero(good)
    kept = forest(comp[i], comp[j])  # a component is linked in itself, so a link to any of its documents is one to all
    i, j = i[kept], j[kept]
    return pd.DataFrame({"a": ids[i], "b": ids[j]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each document; links need `100 * intersection >= percent * union`.

    ids are integers. Rows that repeat an id with the same text are one document that comes out as often; with different
    texts under one id, a link of either joins the id's component, and kept tells of each row whether its own component is
    the id. A null, empty or blank text has no shingles, is linked with nothing and is kept; a text
    of fewer words than `width` has its whole word sequence as its one shingle. Ties and repeated texts go to the smallest
    id. A row without an id is never kept; its component is that of an equal text with one, or null. An empty table gives an
    empty result. Further columns of docs, whatever their names, are not read.
    """
    short_batches(docs.sparkSession)
    marked = staged(signed(docs, id_col, text_col, width, bands, rows), "signed")
    reps = staged(marked.filter("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")), "reps")
    bands_of = marked.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", F.explode("keys").alias("key")).repartition("key")  # moved once, for both that follow
    hubs = bands_of.groupBy("key").agg(F.min("id").alias("hub"), F.min_by("n", "id").alias("m"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("key", "hub", "m")
    members = staged(bands_of.join(hubs, "key"), "members")  # of buckets with a second member; all that follows is about these
    sized = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    stars = staged(members.filter(F.col("id") != F.col("hub")).filter(sized(F.col("n"), F.col("m"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    wanted = staged(members.select("id").distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = staged(sieved(texts, "id", wanted).filter("__maybe").drop("__maybe"), "texts")  # and some more, that no pair asks for
    nearest = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = staged(confirmed(nearest, texts, width, percent), "links")
    first = components(links)
    rest = across(stars.join(nearest, ["a", "b"], "left_anti"), first)
    first = extended(first, staged(confirmed(rest, texts, width, percent), "links"))
    placed = staged(members.join(first.select(F.col("v").alias("id"), "comp"), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp")), "placed")
    open_keys = staged(placed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("id").alias("hub")).filter("low < high"), "open")
    few = placed.join(open_keys.filter(F.col("held") <= SMALL).select("key"), "key", "left_semi")
    one = few.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    two = few.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized(F.col("na"), F.col("nb"))).select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = staged(confirmed(pairs, texts, width, percent), "links")
    large = open_keys.filter(F.col("held") > SMALL).select("key", "hub")
    if not large.isEmpty():
        inside = staged(placed.join(large, "key").select("id", "n", "hub", "comp").distinct(), "inside")
        more = more.union(staged(in_blocks(inside, texts, width, percent), "links"))
    last = extended(first, more)
    homes = reps.join(last.select(F.col("v").alias("rep"), "comp"), "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    named = marked.select("id", "n", "f1", "f2").join(homes, ["f1", "f2"], "left")
    home = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), home.alias("component_id"), F.coalesce(home == F.col("id"), F.lit(False)).alias("kept"))


def in_blocks(inside: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components in clusters of overlapping large buckets: inside has (id, n, hub, comp).

    A cluster's largest component is its main one; main blocks are not compared with each other. The other documents
    are a query set that is compared with all rows, block by block.
    """
    own = inside.groupBy("id").agg(F.min("hub").alias("v"))
    overlaps = inside.join(own, "id").filter("hub <> v").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()  # by hub, not by document
    cluster = own.join(components(overlaps), "v", "left").select("id", F.coalesce("comp", "v").alias("cluster"))
    rows = staged(inside.select("id", "n", "comp").distinct().join(cluster, "id"), "clusters")
    sizes = rows.groupBy("cluster", "comp").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("k"))  # in blocks
    main = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"), F.max("k").alias("k_main"), F.sum("k").alias("k_all"))
    blocks = lambda k: F.ceil(k).cast("int")
    at = rows.join(main, "cluster").withColumn("is_main", F.col("comp") == F.col("main")).withColumn("n_main", blocks(F.col("k_main"))).withColumn("n_rest", F.greatest(F.lit(1), blocks(F.col("k_all") - F.col("k_main"))))
    at = at.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int") + F.when(F.col("is_main"), F.col("n_rest")).otherwise(F.lit(0)))
    all_blocks, rest = F.sequence(F.lit(0), F.col("n_main") + F.col("n_rest") - 1), F.sequence(F.lit(0), F.col("n_rest") - 1)
    dealt = at.select("id", "comp", "cluster", "block", F.explode(F.when(F.col("is_main"), rest).otherwise(all_blocks)).alias("other"))
    keyed = dealt.select("id", "comp", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return keyed.join(texts, "id").groupBy("cluster", "low", "high").applyInPandas(lambda part: block_links(part, width, percent), "a long, b long")
