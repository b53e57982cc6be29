"""Documents linked by the Jaccard similarity of their n-gram sets: a self-join by prefixes, without missing a link.

Every set is put into one order, rare n-grams first. Two sets that are alike share an n-gram among the first few of each
(the prefix), so only those are joined on. Rarity is a count over 2**24 hash buckets of all n-grams: the order needs to be
one and the same for all sets, it needn't be exact. A bucket's count is never below that of its n-grams, so what comes
first is rare indeed, as long as there are few n-grams to a bucket; with more of them results stay whole, but more
candidates are looked at.

1. Equal sets collapse to their smallest id, by a fingerprint of 128 bits.
2. The other ones give a row for each n-gram of their prefix. One that no other prefix holds is dead: it goes, and where
   too many of a document's first ones are dead, so do the document's later ones (positional filter, by the set's own size).
3. A bucket is an n-gram and the documents with it in their prefix. Its members are linked to the smallest one of them if
   the filters by length, position and suffix let the pair through and both full sets confirm it.
4. Buckets that still hold several components go on: in a small one, pairs across components; in a large one, blocks
   of the cluster that it belongs to. A pair is checked once, however many n-grams it shares.
5. Components of all links, and every copy takes its representative's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, shingle_sets, short_batches, staged
from .components import components
from .minhash import confirmed, in_blocks

#: Bits of a counter's number, and those of them that say which part of the counters it is in. Counts end at 255.
COUNT_BITS, PART_BITS = 24, 8
#: Members of a bucket whose pairs are compared one by one.
SMALL = 32
#: Parts of a suffix whose sizes are compared; a pair differs at least by what these do.
PARTS = 8


def required(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least intersection of a set of n with any set that is alike."""
    return -(-n * percent // 100)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def frequencies(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How often n-grams of each hash bucket come, over all documents: 2**COUNT_BITS bytes.

    A task sends its counters in parts, places and counts of those that aren't 0; a part is summed as its rows stream by.
    """
    inside = 1 << (COUNT_BITS - PART_BITS)
    types = "part int, places binary, counts binary"

    def rows(part: int, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        least = np.minimum(counts[at], 255).astype(np.uint8)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "places": [at.astype(np.uint16).tobytes()], "counts": [least.tobytes()]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(0), width):
                np.add.at(total, bucket_of(np.concatenate(sets)), 1)
        for part in range(1 << PART_BITS):
            yield rows(part, total[part * inside : (part + 1) * inside])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = held.setdefault(part, np.zeros(inside, np.int64))
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint8)
        for part, total in held.items():
            yield rows(part, total)

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, types).repartition("part").mapInArrow(add, types)
    out = np.zeros((1 << PART_BITS, inside), np.uint8)
    for r in staged(parts, "frequencies").collect():  # 2**PART_BITS rows, as many bytes as counters or a few times more
        out[r["part"], np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def ordered(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the order of all sets: rare n-grams first, then by hash."""
    return hashes[np.lexsort((hashes, counts[bucket_of(hashes)]))]


def suffix_parts(tokens: np.ndarray, prefix: int) -> np.ndarray:
    """For each place of the prefix, how many n-grams after it fall into each of PARTS parts by hash, as bytes of a long.

    A part counts up to 255; the difference of two counts is never more than that of the true ones.
    """
    part = (mixed(tokens) >> np.uint64(61)).astype(np.int64)
    left = np.bincount(part[prefix:], minlength=PARTS)[None, :] + np.cumsum((part[:prefix, None] == np.arange(PARTS))[::-1], axis=0)[::-1]
    left[np.arange(prefix), part[:prefix]] -= 1  # those after the place, not the one at it
    return np.minimum(left, 255).astype(np.uint8).reshape(-1).view(np.int64)


def prefixed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, counts: Broadcast) -> DataFrame:
    """(id, n, f1, f2, prefix, parts): the size of each set, its fingerprint, its first n-grams, and what follows each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in shingle_sets(batch.column(1), width):
                sizes = np.array([len(s) for s in sets], np.int64)
                f1, f2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                prefixes, parts = [], []
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if not len(s):
                            continue
                        f1[i] = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
                        f2[i] = mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)
                        tokens, k = ordered(s, counts.value), len(s) - required(len(s), percent) + 1
                        prefixes.append(tokens[:k])
                        parts.append(suffix_parts(tokens, k))
                keep = np.where(sizes > 0, sizes - required(sizes, percent) + 1, 0)
                ends = pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))) for x in (prefixes, parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(f1), pa.array(f2), *lists], names=["id", "n", "f1", "f2", "prefix", "parts"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, prefix array<long>, parts array<long>")


def overlap(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of two sets of these sizes that are alike."""
    return F.ceil(percent * (n + m) / (100 + percent))


def possible(one: str, two: str, percent: int) -> Column:
    """Filters by length, position and suffix on two rows of a bucket, each with n, pos (the n-gram's place), live and parts.

    live counts the document's earlier n-grams that other prefixes hold. What both share before this one is among these,
    and after it no more can be shared than the rest of either, nor than the sizes of their parts allow.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m = c(one, "n"), c(two, "n")
    length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    rest_n, rest_m = n - c(one, "pos") - 1, m - c(two, "pos") - 1
    needed = overlap(n, m, percent) - 1 - F.least(c(one, "live"), c(two, "live"))  # after this place
    size = lambda side, k: F.shiftrightunsigned(c(side, "parts"), 8 * k).bitwiseAND(255)
    apart = sum((F.abs(size(one, k) - size(two, k)) for k in range(PARTS)), F.lit(0))
    return length & (F.least(rest_n, rest_m) >= needed) & (apart <= rest_n + rest_m - 2 * needed)


def band(n: Column, percent: int) -> Column:
    """Sizes in steps of the similarity: two sets that are alike are in the same band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(id_col, n_shingles, component_id) for each document; links need `100 * intersection >= percent * union`.

    ids are integers. Rows that repeat an id with the same text are one document that comes out as often; with different
    texts under one id, a link of either joins the id's component. A null, empty or blank text has no n-grams and is linked
    with nothing; a text of fewer words than `width` has its whole word sequence as its one n-gram. component_id is the
    smallest id that links reach, the own one included; a row without an id has that of an equal text with one, or null. An
    empty table gives an empty result. Further columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    counts = spark.sparkContext.broadcast(frequencies(docs, text_col, width))  # 2**COUNT_BITS numbers at any size
    marked = staged(prefixed(docs, id_col, text_col, width, percent, counts), "prefixes")
    reps = staged(marked.filter("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")), "reps")
    at = marked.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x")).select(F.col("x.prefix").alias("key"), "id", "n", F.col("pos").cast("long").alias("pos"), "x.parts")
    shared = at.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
    earlier = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a prefix is a part of one text
    alive = at.join(shared, "key").withColumn("live", F.count(F.lit(1)).over(earlier))
    fit = staged(alive.filter(F.col("live") + F.col("n") - F.col("pos") >= F.ceil(F.col("n") * percent / 100)), "alive")
    hubs = fit.groupBy("key").agg(F.min(F.struct("id", "n", "pos", "live", "parts")).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = staged(fit.join(hubs, "key").select("key", F.struct("id", "n", "pos", "live", "parts").alias("own"), "hub", "held"), "members")
    stars = staged(members.filter((F.col("own.id") != F.col("hub.id")) & possible("own", "hub", percent)).select(F.col("hub.id").alias("a"), F.col("own.id").alias("b")).distinct(), "stars")
    all_texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    of = lambda ids: staged(all_texts.join(ids.distinct(), "id", "left_semi"), "texts")
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    links = staged(confirmed(stars, of(ends(stars)), width, percent), "links")
    first = components(links)
    # a bucket of two holds no pair but the one with its smallest member
    placed = members.filter("held > 2").select("key", "own", F.col("own.id").alias("id")).join(first.select(F.col("v").alias("id"), "comp"), "id", "left").select("key", "own", F.coalesce("comp", "id").alias("comp"))
    # a set meets those of its own band of sizes and of the next one
    step = band(F.col("own.n"), percent)
    banded = staged(placed.withColumn("band", F.explode(F.array(step, step - 1))), "placed")
    mixed_up = staged(banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("own.id").alias("hub")).filter("low < high"), "open")
    few = banded.join(mixed_up.filter(F.col("held") <= SMALL).select("key", "band"), ["key", "band"], "left_semi")
    one, two = (few.select("key", "band", F.col("own").alias(x), F.col("comp").alias(f"c{x}")) for x in ("p", "q"))
    across = one.join(two, ["key", "band"]).filter((F.col("p.id") < F.col("q.id")) & (F.col("cp") != F.col("cq")) & possible("p", "q", percent))
    pairs = staged(across.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    more = staged(confirmed(pairs, of(ends(pairs)), width, percent), "links")
    large = mixed_up.filter(F.col("held") > SMALL).select("key", "band", "hub")
    if not large.isEmpty():
        inside = staged(banded.join(large, ["key", "band"]).select("own.id", "own.n", "hub", "comp").distinct(), "inside")
        more = more.union(staged(in_blocks(inside, of(inside.select("id")), width, percent), "links"))
    last = components(links.union(more))
    homes = reps.join(last.select(F.col("v").alias("rep"), "comp"), "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    named = marked.select("id", "n", "f1", "f2").join(homes, ["f1", "f2"], "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")).alias("component_id"))
