"""Substring dedup with difference-cover anchors.

Words that lie in a window of `window` words go if the window's words also
start anywhere else, in another document or the same one.

A difference cover of a period holds, for any two places, a shift below the
period that brings both to places of the cover.  So of two equal windows, some
place is a place of the cover in both documents, at the same distance from
their starts, and the words that follow it there are equal: an anchor.

1. Anchors, short windows at the cover's places only, are hashed and counted.
   One that two different texts hold, or one text twice, is repeated.
2. Texts that hold repeated anchors are kept, one row for each text, with the
   places of those.
3. An anchor is extended to every window that holds it: those are hashed with
   128 bits, and counted.  No other window can start anywhere else.
4. Windows that are counted twice cover the words that go.

No members of a group are paired: a passage of any number of documents is one
key.  Keys are added up before each exchange, hot ones are salted where their
places are found again, and only texts of step 2 are moved, once each however
many copies they have.  Copies of a whole text need none of this: its windows,
if it has any, all start in the copy too.

Defined results: words are runs of bytes other than space and 0x09 to 0x0D, with
case; a null or empty text has none; a document with fewer words than a window
loses nothing; repeated rows are copies of each other, with or without an id;
an empty table gives no rows; other columns, whatever their names, are kept.
Texts and words of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, HOT_ROWS, Scratch, hot_join, slices
from .line_dedup import filtered
from .shingles import IS_WORD, POWERS, mixed

#: Least words of an anchor, where the window allows it.
LEAST_ANCHOR = 12
#: Words of more bytes are hashed by BLAKE2, as the sum of a long one has structure.
LONG_WORD = 256
#: Two tables of random numbers for bytes, for two independent hashes.
TABLES = tuple(mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed)) for seed in (0x517CC1B727220A95, 0x2545F4914F6CDD1D))


# Perfect difference sets; each difference but 0 occurs once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


@dataclass(frozen=True)
class Anchors:
    """The longest period whose anchors have LEAST_ANCHOR words or more."""

    window: int

    @cached_property
    def period(self) -> int:
        return max(p for p in COVERS if p == 1 or self.window - p + 1 >= LEAST_ANCHOR)

    @property
    def words(self) -> int:
        return self.window - self.period + 1

    @cached_property
    def of_cover(self) -> np.ndarray:
        return np.isin(np.arange(self.period), COVERS[self.period])


def word_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of several texts, one after the other, that start
    at these bytes, and the place of each text's first word, and one past the last."""
    inside = IS_WORD[data]
    at = starts[starts < len(data)]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    fresh[at] = inside[at]  # a word does not run over into the next text
    begin = np.flatnonzero(fresh)
    closes = ~inside
    closes[at] = True
    ends = np.r_[np.flatnonzero(closes), len(data)]
    stop = ends[np.searchsorted(ends, begin, "right")]
    up, down = POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up, out=sums[1:])
    words = mixed((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    for i in np.flatnonzero(stop - begin > LONG_WORD):
        digest = hashlib.blake2b(data[begin[i] : stop[i]].tobytes(), digest_size=8, key=table[:2].tobytes()).digest()
        words[i] = np.frombuffer(digest, np.uint64)[0]
    return words, np.r_[np.searchsorted(begin, starts), len(begin)]


def texts_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one text after the other, and where each starts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0]


def run_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n words from each of these places on."""
    roles = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out += words[at + i] * roles[i]
    return mixed(out).view(np.int64)


def anchor_places(bounds: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the anchors of texts that have a window; places count from the text's start."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(bounds[-1]) - bounds[text]
    here = anchors.of_cover[place % anchors.period] & (place + anchors.words <= sizes[text]) & (sizes[text] >= anchors.window)
    return text[here], place[here]


def scanned_anchors(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches (t, u, text) with their anchors' texts, places and hashes."""
    for batch in slices(batches, "text", 2 << 20):
        words, bounds = word_hashes(*texts_bytes(batch.column("text")), TABLES[0])
        text, place = anchor_places(bounds, anchors)
        yield batch, text, place, run_hashes(words, bounds[text] + place, anchors.words)


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(t, u, who, text): two hashes that name the text, and one of the id."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"))
    return own.select(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"), F.xxhash64("doc_id").alias("who"), "doc_id", "text")


def plain_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, t, u, who, n_words, whole) of every row: its number of words and
    the digest of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            split = [x.encode().split() for x in batch.column("text").to_pylist()]
            made = [pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t", "u", "who")), *made], names=["doc_id", "t", "u", "who", "n_words", "whole"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t long, u long, who long, n_words long, whole string")


def repeated_anchors(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """(hash, times) of anchors that two texts hold, or one text twice.  A row
    names a text; a second one of another name says that it holds the anchor twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, _, hashes in scanned_anchors(batches, anchors):
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            again = np.zeros(len(hashes), bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
            names = batch.column("t").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.where(again, ~names, names))], names=["hash", "t"])

    found = rows.select("t", "text").mapInArrow(run, "hash long, t long")
    counts = found.groupBy("hash").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("times"))
    return counts.where("low < high").select("hash", "times")


def places_of_anchors(rows: DataFrame, repeated: DataFrame, anchors: Anchors) -> DataFrame:
    """(t, u, places) of each text with repeated anchors, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, place, hashes in scanned_anchors(batches, anchors):
            name = [pa.array(batch.column(c).to_numpy()[text]) for c in "tu"]
            yield pa.RecordBatch.from_arrays([pa.array(hashes), *name, pa.array(place.astype(np.int32))], names=["hash", "t", "u", "place"])

    found = rows.select("t", "u", "text").mapInArrow(run, "hash long, t long, u long, place int")
    hits = hot_join(filtered(found, "hash", repeated), repeated, "hash", "times", F.struct("t", "place"))
    hits = hits.select("t", "u", "place").distinct()  # copies of a text name the same places
    return hits.groupBy("t", "u").agg(F.array_sort(F.collect_list("place")).alias("places"))


def windows(held: DataFrame, anchors: Anchors) -> DataFrame:
    """(k1, k2, num, place) of every window that holds a repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, starts = texts_bytes(batch.column("text"))
            (one, bounds), (two, _) = (word_hashes(data, starts, table) for table in TABLES)
            lists = batch.column("places")
            anchor = lists.flatten().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            first = np.maximum(anchor - (anchors.period - 1), 0)
            last = np.minimum(anchor, np.diff(bounds)[text] - anchors.window)
            # Steps up and down at the first and after the last window of each anchor.
            steps = np.zeros(bounds[-1] + 1, np.int64)
            np.add.at(steps, bounds[text] + first, 1)
            np.add.at(steps, bounds[text] + last + 1, -1)
            at = np.flatnonzero(np.cumsum(steps)[:-1] > 0)
            of = np.searchsorted(bounds, at, "right") - 1
            keys = [pa.array(run_hashes(words, at, anchors.window)) for words in (one, two)]
            num = pa.array(batch.column("num").to_numpy()[of])
            yield pa.RecordBatch.from_arrays([*keys, num, pa.array((at - bounds[of]).astype(np.int32))], names=["k1", "k2", "num", "place"])

    return held.select("num", "places", "text").mapInArrow(run, "k1 long, k2 long, num long, place int")


def rest_of_texts(held: DataFrame, window: int) -> DataFrame:
    """(t, u, n_removed, whole, text) of texts with the starts of their repeated
    windows: how many words go, the digest of the others and these themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts")):
                words = text.encode().split()
                at = starts.values.to_numpy()
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                stays = np.cumsum(steps)[:-1] == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(stays)])
                out.append((len(words) - int(stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            made = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("u"), *made], names=["t", "u", "n_removed", "whole", "text"])

    return held.select("t", "u", "text", "starts").mapInArrow(run, "t long, u long, n_removed long, whole string, text string")


def shortened(docs: DataFrame, window: int, scratch: Scratch, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with its number of words (doc_id, t, u, who, n_words, whole);
    the texts that occur more than once and lose all words (t, u, copies, n_words);
    and the texts that lose some (t, u, n_removed, whole, text), copies left out."""
    anchors, rows = Anchors(window), named(docs, doc_id, text)
    plain = scratch.write(plain_digests(rows), "plain")
    texts = plain.groupBy("t", "u").agg(F.count("*").alias("copies"), F.min("who").alias("who"), F.min("n_words").alias("n_words"))
    texts = scratch.write(texts.where(F.col("n_words") >= window), "texts")
    copied = texts.where("copies > 1").select("t", "u", "copies", "n_words")

    repeated = scratch.write(repeated_anchors(rows, anchors), "repeated")
    places = places_of_anchors(rows, repeated, anchors)
    places = scratch.write(places.join(texts.select("t", "u", "who"), ["t", "u"]), "places")
    # One row of each text: that of its least id, so copies do not meet in one task.
    own = filtered(rows.select("t", "u", "who", "text"), "t", places).join(places, ["t", "u", "who"])
    held = scratch.write(own.withColumn("num", F.monotonically_increasing_id()), "held")

    found = windows(held, anchors)
    counts = found.groupBy("k1", "k2").agg(F.count("*").alias("times")).where("times > 1")
    counts = scratch.write(counts.select("k1", F.struct("k1", "k2").alias("key"), "times"), "counts")
    again = filtered(found, "k1", counts).withColumn("key", F.struct("k1", "k2")).drop("k1", "k2")
    again = hot_join(again, counts.drop("k1"), "key", "times", F.struct("num", "place"))
    starts = again.groupBy("num").agg(F.collect_list("place").alias("starts"))
    single = texts.where("copies = 1").select("t", "u")
    lost = held.select("num", "t", "u", "text").join(starts, "num").join(single, ["t", "u"], "left_semi")
    return plain, copied, rest_of_texts(lost, window)


def digests(docs: DataFrame, window: int, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    plain, copied, lost = shortened(docs, window, scratch, doc_id, text)
    lost = scratch.write(lost.select("t", "u", "n_removed", F.col("whole").alias("kept")), "lost")
    nothing = hashlib.sha256(b"").hexdigest()
    # Texts with very many copies are few, as all their rows are counted; they are broadcast, so their rows stay where they are.
    total = copied.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") >= max(HOT_ROWS, -(-total // HOT_KEYS))
    every = copied.select("t", "u", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept"), hot.alias("hot"))
    few = F.broadcast(every.where("hot").drop("hot"))
    cold = every.where("not hot").drop("hot").unionByName(lost)
    out = plain.join(few, ["t", "u"]).unionByName(plain.join(few, ["t", "u"], "left_anti").join(cold, ["t", "u"], "left"), allowMissingColumns=True)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256")
    )


def deduplicated(docs: DataFrame, window: int, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with all their columns, where texts that lose words have the others,
    joined by one space, as their text; other texts stay as they are.  Texts
    with copies lose all their words."""
    _, copied, lost = shortened(docs, window, scratch, doc_id, text)
    lost = lost.select("t", "u", F.lit(1).cast("long").alias("copies"), F.col("text").alias("kept"))
    changed = scratch.write(copied.select("t", "u", "copies", F.lit("").alias("kept")).unionByName(lost), "changed")
    changed = changed.select(F.struct("t", "u").alias("name"), "copies", "kept")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(F.xxhash64(whole).alias("t"), F.xxhash64(F.lit(1), whole).alias("u")).alias("name"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    fresh = hot_join(rows, changed, "name", "copies", F.col("row")[doc_id])
    as_before = rows.join(changed.select("name"), "name", "left_anti")
    column = lambda c: F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c)
    return fresh.select(*map(column, docs.columns)).unionByName(as_before.select("row.*"))
