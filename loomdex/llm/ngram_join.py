"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles in one global order: shingles of
crowded cells of a fixed-size count sketch come last, ties by hash.  If two
sets overlap in o, and a prefix leaves r of its set's shingles out, then the
shingles shared by two prefixes are at least o less the greater r.  A longer
prefix thus asks for more shared shingles.  Each document takes the length
whose estimated cost is least: the postings that its prefix reads, and the
candidates that they let through, which by Markov's bound fall as the number
of required matches rises.

Equal sets are joined at once, by a digest.  The rest goes in two rounds, so
that a group of near copies costs no more than its size:

1. in each posting list, every document meets the list's pivot, the member
   with the fewest shingles of its own, and candidates are verified;
2. documents that share postings and are in different components meet, with
   bounds of sizes, matches, places and parities as join conditions, and
   candidates are verified.  A pair of known sizes needs shorter prefixes than
   a document by itself, so matches count only up to the pair's own place.  A
   set's parities are those of its shingles' counts in cells: two sets differ
   in as many shingles at least as cells.  PARITY_BITS cells go through the
   join; as many as the set has shingles are compared after it.

Every link between different components is found in round 2, so components
are exact.  Sets of candidates are hashed again from their texts and compared
in full.

Defined results: null, empty and blank texts have no shingles and are alone;
ties do not arise; repeated rows are copies; an empty table gives no rows; a
text of any length is one set, and work is linear in its length; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, give_back, hot_join, slices
from .components import components
from .shingles import shingle_sets

#: Cells of the count sketch, in bits, and cells of one of its rows.
SKETCH_BITS, SEGMENT_BITS = 18, 13
#: Most shared shingles that a document may ask for, and the cost of a candidate in postings.
MOST_MATCHES, CANDIDATE_COST = 24, 2.0
#: Cells of a set's parities, 64 to a word.
PARITY_BITS = 512
PARITY_WORDS = [f"parity_{i}" for i in range(PARITY_BITS // 64)]
#: Bits of the filter of candidates that spares texts from the exchange.
FILTER_BITS = 25


@dataclass(frozen=True)
class Jaccard:
    """At least part / whole of the union is shared."""

    part: int
    whole: int

    def least_overlap(self, n: np.ndarray | int):
        """Of a set of n with any linked set."""
        return -(-self.part * n // self.whole)

    def least_overlap_of(self, n: Column) -> Column:
        return F.ceil(F.lit(self.part) * n / F.lit(self.whole))

    def overlap(self, n: Column, m: Column) -> Column:
        """Of linked sets of n and m."""
        return F.ceil(F.lit(self.part) * (n + m) / F.lit(self.part + self.whole))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return self.whole * F.least(n, m) >= self.part * F.greatest(n, m)

    def linked(self, shared: Column, n: Column, m: Column) -> Column:
        return self.whole * shared >= self.part * (n + m - shared)


def as_signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def count_sketch(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Occurrences of shingles in all documents, by the leading bits of their
    hashes.  Tasks add up their own counts; cells are summed in Spark."""
    rows = 1 << (SKETCH_BITS - SEGMENT_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in slices(batches, 0):
            counts += binned(list(shingle_sets(part.column(0), width)))
        parts = counts.reshape(rows, -1)
        small = [p.astype(np.min_scalar_type(int(p.max()))) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(rows), pa.int32()), pa.array([p.dtype.itemsize for p in small], pa.int32()),
             pa.array([p.tobytes() for p in small], pa.binary())],
            names=["segment", "size", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, size, counts in zip(*(c.to_pylist() for c in batch.columns)):
                one = np.frombuffer(counts, f"u{size}").astype(np.int64)
                total[segment] = total[segment] + one if segment in total else one
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
            names=["segment", "counts"],
        )

    own = docs.select(text).mapInArrow(partial, "segment int, size int, counts binary")
    summed = own.repartition(rows, "segment").mapInArrow(add, "segment int, counts binary")
    out = np.zeros((rows, 1 << SEGMENT_BITS), np.int64)
    for r in summed.collect():
        out[r["segment"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def binned(sets: list[np.ndarray]) -> np.ndarray:
    if not sets:
        return np.zeros(1 << SKETCH_BITS, np.int64)
    cells = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
    return np.bincount(cells.astype(np.int64), minlength=1 << SKETCH_BITS)


def crowding(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its place in the global order (0 for an ordinary one) and
    the estimated number of documents of one of its shingles."""
    usual = max(float(np.median(sketch)), 1.0)
    noise = 4 * np.sqrt(usual) + 4
    excess = np.maximum(sketch - usual - noise, 0)
    return np.ceil(np.log2(1 + excess / noise)).astype(np.int16), 1 + excess


def choose_prefix(hashes: np.ndarray, levels: np.ndarray, frequency: np.ndarray, measure: Jaccard) -> np.ndarray:
    """The prefix, in the global order, whose estimated cost is least."""
    cells = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    order = np.argsort(levels[cells], kind="stable")
    n = len(hashes)
    least = int(measure.least_overlap(n))
    matches = np.arange(1, min(MOST_MATCHES, least) + 1)
    read = np.cumsum(frequency[cells[order]])[n - least + matches - 1]
    best = int(matches[np.argmin(read * (1 + CANDIDATE_COST / matches) + (n - least + matches))])
    return hashes[order[: n - least + best]]


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The parities of the cell counts, as 64-bit words."""
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def own_bits(n: int) -> int:
    """Cells for the parities of a set of n: a power of two."""
    return max(PARITY_BITS, 1 << max(n - 1, 0).bit_length())


def prefixes(docs: DataFrame, doc_id: str, text: str, width: int, sketch: np.ndarray, measure: Jaccard) -> DataFrame:
    """(doc_id, n, digest, prefix, parities, and those in fewer cells) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(crowding(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, frequency = shared.value
        for batch in slices(batches, 1):
            sizes, digests, chosen, odd, fine = [], [], [], [], []
            for found in shingle_sets(batch.column(1), width):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                chosen.append(as_signed(choose_prefix(found, levels, frequency, measure)) if len(found) else None)
                odd.append(parities(found, PARITY_BITS))
                fine.append(parities(found, own_bits(len(found))) if len(found) else None)
            words = np.array(odd, np.int64).reshape(len(odd), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(chosen, pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int64())), *(pa.array(c) for c in words.T)],
                names=["doc_id", "n", "digest", "prefix", "parities", *PARITY_WORDS],
            )

    schema = "doc_id long, n long, digest binary, prefix array<long>, parities array<long>, " + ", ".join(f"{w} long" for w in PARITY_WORDS)
    return docs.select(doc_id, text).mapInArrow(run, schema)


def candidate_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of hashed ids; false hits cost only work."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    rows = (
        ids.groupBy(F.bitmap_bucket_number(place).alias("segment"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    size = 4096
    out = np.zeros((1 << FILTER_BITS) // 8 + 2 * size, np.uint8)
    for r in rows:
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidate_sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, hashes) of the documents in `ids`, hashed from their texts."""
    bits = docs.sparkSession.sparkContext.broadcast(candidate_filter(ids))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    own = own.select("id", "text", F.bitmap_bucket_number(place).alias("segment"), F.bitmap_bit_position(place).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            segment, bit = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            hit = bits.value[segment * 4096 + bit // 8] >> (bit % 8).astype(np.uint8) & 1
            some = batch.filter(pa.array(hit.astype(bool)))
            if some.num_rows:
                found = [as_signed(s) for s in shingle_sets(some.column(1), width)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "hashes"]
                )

    return own.mapInArrow(run, "id long, hashes array<long>").join(ids, "id", "left_semi").dropDuplicates(["id"])


def verified(
    docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, width: int, measure: Jaccard, scratch: Scratch
) -> DataFrame:
    """The pairs (a, b) of a written table whose whole sets are linked."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = scratch.write(candidate_sets(docs, ids, doc_id, text, width), "sets")
    side = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(measure.linked(shared, F.size("set_a"), F.size("set_b"))).select("a", "b")


def differing_cells(a: str, b: str) -> Column:
    """In how many cells two parities differ; the finer one is folded if the
    other has half as many cells."""

    def folded(x: str, than: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda i, j: i.bitwiseXOR(j))
        return F.when(F.size(x) > F.size(than), both).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda i, j: F.bit_count(i.bitwiseXOR(j)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def enough(m: Column, measure: Jaccard) -> Column:
    """Whether m shared prefix shingles leave a link between a and b possible."""
    rest = F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    return m >= measure.overlap(F.col("n_a"), F.col("n_b")) - rest


def near_groups(
    docs: DataFrame, width: int, measure: Jaccard, scratch: Scratch, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`."""
    of_document = F.count("*").over(Window.partitionBy("id"))
    sketch = count_sketch(docs, text, width)
    sets = scratch.write(prefixes(docs, doc_id, text, width, sketch, measure), "prefixes")
    ids = sets.select("doc_id", "n", "digest")
    equal = ids.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.write(equal, "equal")

    postings = sets.select(F.col("doc_id").alias("id"), F.posexplode("prefix").alias("place", "token"))
    common = postings.groupBy("token").count().where("count > 1")
    own = sets.where("digest is not null").select(F.col("doc_id").alias("id"), "n", F.size("prefix").alias("p"))
    own = own.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    live = postings.join(common.select("token"), "token").join(own, "id")
    live = scratch.write(live.withColumn("live", of_document), "live")

    def side(name: str, *more: str) -> DataFrame:
        return live.select("token", F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "p", "live", *more)))

    # Round 1: every member of a posting list against the list's pivot.
    member = F.struct((F.col("p") - F.col("live")).alias("alone"), "id", "n", "p")
    pivots = live.groupBy("token").agg(F.min(member).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    pivots = pivots.select("token", "size", F.col("pivot.id").alias("b"), F.col("pivot.n").alias("n_b"), F.col("pivot.p").alias("p_b"))
    met = hot_join(side("a"), scratch.write(pivots, "pivots"), "token", "size", F.col("a")).where(F.col("a") != F.col("b"))
    met = met.where(measure.sizes_fit(F.col("n_a"), F.col("n_b")))
    met = met.groupBy("a", "b", "n_a", "n_b", "p_a", "p_b").agg(F.count("*").alias("m")).where(enough(F.col("m"), measure))
    likeliest = Window.partitionBy("a").orderBy(F.desc("m"), "b")
    met = met.withColumn("place", F.row_number().over(likeliest)).where("place = 1").select("a", "b")
    star = scratch.write(met, "star")
    links = verified(docs, star, doc_id, text, width, measure, scratch)
    first = components(links, scratch)
    scratch.drop_all_but(sets, reps, live, first)

    # Round 2: members of a posting list that are still in different components.
    named = first.withColumnRenamed("node", "id")
    live = live.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_lists = live.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    live = live.drop("live").join(mixed_lists.where("low < high").select("token"), "token")
    odd = sets.select(F.col("doc_id").alias("id"), *PARITY_WORDS).dropDuplicates(["id"])
    # Only shingles of lists that are still open can be shared with another component.
    live = scratch.write(live.withColumn("live", of_document).join(odd, "id"), "mixed")
    left, right = (side(x, "component", "place", *PARITY_WORDS) for x in "ab")
    rest = F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    possible = F.least("live_a", "live_b") >= measure.overlap(F.col("n_a"), F.col("n_b")) - rest
    apart = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
    fits = measure.sizes_fit(F.col("n_a"), F.col("n_b"))
    # The matches that both prefixes of a pair of these sizes must hold, and where they can lie.
    matches = F.least(*(F.col(f"p_{x}") - F.col(f"n_{x}") + measure.least_overlap_of(F.col(f"n_{x}")) for x in "ab"))
    reach = matches - measure.overlap(F.col("n_a"), F.col("n_b"))
    within = (F.col("place_a") < F.col("n_a") + reach) & (F.col("place_b") < F.col("n_b") + reach)
    differing = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in PARITY_WORDS), F.lit(0))
    allowed = F.col("n_a") + F.col("n_b") - 2 * measure.overlap(F.col("n_a"), F.col("n_b"))
    on = (left["token"] == right["token"]) & apart & fits & within & possible & (differing <= allowed)
    met = left.join(right, on).groupBy("a", "b", "n_a", "n_b", "p_a", "p_b").agg(F.count("*").alias("m"))
    met = scratch.write(met.where(F.col("m") >= matches).select("a", "b", "n_a", "n_b"), "met")
    fine = sets.select(F.col("doc_id").alias("id"), "parities")
    ends = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    fine = scratch.write(fine.join(ends, "id", "left_semi").dropDuplicates(["id"]), "fine")
    own = lambda x: fine.select(F.col("id").alias(x), F.col("parities").alias(f"fine_{x}"))
    met = met.join(own("a"), "a").join(own("b"), "b")
    pairs = scratch.write(met.where(differing_cells("fine_a", "fine_b") <= allowed).select("a", "b"), "pairs")
    links = verified(docs, pairs, doc_id, text, width, measure, scratch)
    up = named.select(F.col("id"), F.col("component"))
    ends = links.join(up.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(up.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(ends, scratch)
    scratch.drop_all_but(sets, reps, first, second)

    top = reps.join(named.select(F.col("id").alias("rep"), F.col("component").alias("c1")), "rep", "left")
    top = top.withColumn("c1", F.coalesce("c1", "rep"))
    top = top.join(second.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left")
    top = scratch.write(top.select("digest", "copies", F.coalesce("c2", "c1").alias("component_id")), "top")
    alone = ids.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = hot_join(ids.where("digest is not null"), top, "digest", "copies", F.col("doc_id"))
    # A null id that repeats another document's set is in that one's component.
    out = out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without those that are not their component's smallest id."""
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
