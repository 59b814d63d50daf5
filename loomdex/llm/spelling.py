"""Grouping of spelling variants over forward and reversed sorted dictionaries.

A dictionary of words and their counts is made of all texts.  Two words are
near if one inserted, deleted or replaced code point tells them apart.  Of two
near words let s be the shorter length; cut s places in the middle, and one
half holds the edit while the other is intact.

1. Each word takes part as the shorter (s is its length) and as the longer of
   two (s is one less).  For each s there are two open intervals of places, the
   two halves.  Words with the same text around an interval make a block: around
   the second half that is a shared prefix, around the first a shared suffix.
2. Blocks are counted.  Those that cannot hold a pair go.  One with too many
   pairs is subdivided: its interval is cut in the middle, so its words share
   more of the prefix or more of the suffix.  That is repeated until none is
   too large; an interval of one place is not cut, as the alphabet bounds its block.
3. The blocks are written out in two orders: those of the forward dictionary by
   prefix, those of the reversed one by the reversed suffix.  They are dealt by
   ranges, sorted, and scanned; each is a run of rows.
4. Pairs within a block are verified.  A pair is taken in the one block whose
   interval holds the first place where the two differ, so none counts twice.

A word's form is its near word of the greatest count, if that is `ratio` times
its own; following forms leads to its root.  Counts grow along that path, so it
ends after a number of steps that is logarithmic in the greatest count.

Defined results: a null or empty text has no words; a null id counts as an
empty one where words are damaged; repeated rows count again; ties between
forms go to the smaller word by code points; an empty table gives no rows;
other columns, whatever their names, do not matter.  Texts and words of any
length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, hot_join

LETTER = r"[A-Za-zÀ-ÿ]"
#: Comparisons (shorter words by all words) from which on a block is subdivided.
BLOCK_PAIRS = 512
#: Pairs of a batch that the scan gives out.
PAIR_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """Least length and count of a word, how many times its own count a form's
    must be (more than once, else forms could go round), and of how many places
    in texts one loses a code point (None: none does)."""

    min_chars: int = 6
    min_count: int = 5
    ratio: int = 5
    damage_every: int | None = 199

    def __post_init__(self):
        if self.ratio <= 1:
            raise ValueError("a form must be more frequent than its word")


def words_of(docs: DataFrame, settings: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): every run of letters that is long enough, damaged as the settings say."""
    # A run only gets shorter, so shorter ones are not needed.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{LETTER}{{{settings.min_chars},}}"), F.lit(0))
    # An outer explode: for an inner one, a filter is inferred that cuts every text again.
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode_outer(runs).alias("run"))
    # Of ASCII letters alone, `lower` changes A to Z only and is much faster.
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", ascii_uppercase, ascii_lowercase))
    rows = rows.where("run is not null").select("doc", lowered.alias("run"))
    if settings.damage_every is None:
        return rows.select(F.col("run").alias("word"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % settings.damage_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= settings.min_chars)


def dictionary(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that occur often enough."""
    counted = words_of(docs, settings, doc_id, text).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= settings.min_count)


def prefix() -> Column:
    """What a word holds before its block's interval."""
    return F.substring("word", F.lit(1), F.col("low"))


def suffix() -> Column:
    """What it holds after it."""
    rest = F.col("s") - F.col("high")
    return F.substring(F.col("word"), F.length("word") - rest + 1, rest)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, s, low, high, reversed) with a short name of their block,
    where a mistake costs only work."""
    return rows.withColumn("key", F.xxhash64("s", "low", "high", prefix(), suffix()))


def halves(words: DataFrame) -> DataFrame:
    """Each word as the shorter and as the longer of two, with either half open."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s"))
    return cut(rows.where("s > 0").select("*", F.lit(0).alias("low"), F.col("s").alias("high"), F.lit(None).cast("boolean").alias("reversed")))


def cut(rows: DataFrame) -> DataFrame:
    """Rows with either half of their interval.  The first halves of all belong
    to the reversed dictionary, the second ones to the forward one, and so do their parts."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    part = lambda low, high, back: F.struct(low.alias("low"), high.alias("high"), F.coalesce("reversed", F.lit(back)).alias("reversed"))
    both = F.array(part(F.col("low"), middle, True), part(middle, F.col("high"), False))
    found = rows.select("word", "n", "s", F.explode(both).alias("p")).select("word", "n", "s", "p.*")
    return keyed(found.where("low < high"))


def blocks(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, s, low, high, reversed) of all blocks that can hold a pair, none too large."""
    rows, done = scratch.write(halves(words), "halves"), []
    while True:
        short = F.when(F.length("word") == F.col("s"), 1)
        counts = rows.groupBy("key").agg(F.count("*").alias("members"), F.count(short).alias("short"))
        counts = scratch.write(counts.where("short > 0 and members > 1"), "counts")
        sized = hot_join(rows, counts, "key", "members", F.col("word"))
        sized = sized.withColumn("large", (F.col("short") * F.col("members") > BLOCK_PAIRS) & (F.col("high") - F.col("low") > 1))
        sized = scratch.write(sized.select("word", "n", "s", "low", "high", "reversed", "large"), "sized")
        scratch.drop(rows, counts)
        done.append(sized.where("not large").drop("large"))
        large = sized.where("large")
        if large.isEmpty():
            return reduce(DataFrame.union, done)
        rows = scratch.write(cut(large), "cut")


def pairs_of_block(members: list[tuple[str, int]], s: int, low: int, high: int) -> Iterator[tuple[str, int, str, int]]:
    """The near pairs whose first difference lies in the open interval (for one
    at the end of the shorter word: in the last interval)."""
    short = [(w[low:high], w, n) for w, n in members if len(w) == s]
    long = [(w[low : high + 1], w, n) for w, n in members if len(w) != s]
    for i, (x, word, n) in enumerate(short):
        for y, other, m in short[i + 1 :]:
            p = 0
            while x[p] == y[p]:  # words of a block differ in the interval only
                p += 1
            if x[p + 1 :] == y[p + 1 :]:
                yield word, n, other, m
        for y, other, m in long:
            p = 0
            while p < len(x) and x[p] == y[p]:
                p += 1
            if x[p:] == y[p + 1 :] and (p < len(x) or high == s):
                yield word, n, other, m


PAIR = pa.schema([("word", pa.string()), ("other", pa.string()), ("m", pa.int64())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs, both ways, of blocks that follow one another."""
    held, members, out = None, [], []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIR)], schema=PAIR)
        out.clear()
        return made

    def close() -> None:
        if len(members) > 1:
            for word, n, other, m in pairs_of_block(members, *held[2:5]):
                out.append((word, other, m))
                out.append((other, word, n))

    for given in batches:
        for *block, word, n in zip(*(c.to_pylist() for c in given.columns)):
            if block != held:
                close()
                held, members = block, []
                if len(out) >= PAIR_ROWS:
                    yield batch()
            members.append((word, n))
    close()
    if out:
        yield batch()
    give_back()


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, other, m) for each word and each near word, m being that one's count."""
    front = F.when(F.col("reversed"), F.reverse(suffix())).otherwise(prefix())
    back = F.when(F.col("reversed"), prefix()).otherwise(suffix())
    rows = blocks(words, scratch).select("reversed", front.alias("front"), "s", "low", "high", back.alias("back"), "word", "n")
    order = ["reversed", "front", "s", "low", "high", "back"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(scan, "word string, other string, m long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of rows (word, form): the last word that forms lead to."""
    up = scratch.write(forms.select("word", F.col("form").alias("root")), "forms")
    while True:  # every round doubles the steps that a pointer takes
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = up.join(further, "root", "left")
        jumped = jumped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        jumped = scratch.write(jumped, "jumped")
        scratch.drop(up)
        up = jumped
        if jumped.where("moved").isEmpty():
            return up.select("word", "root")


def variants(docs: DataFrame, scratch: Scratch, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the dictionary."""
    words = scratch.write(dictionary(docs, settings, doc_id, text), "words")
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_pairs(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best)
    best_n = -F.col("best.less")
    is_form = best_n >= settings.ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, best_n).alias("form_n"),
    )
    found = scratch.write(found, "found")
    ends = roots(found.where("form is not null"), scratch)
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
