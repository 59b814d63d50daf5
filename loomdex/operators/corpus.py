"""Corpora: loading chunks, unions, identity and order of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METADATA = ("id", "title", "source", "textbook", "pmid", "journal", "year")


def documents(chunks: DataFrame) -> DataFrame:
    """content and the seven metadata columns of corpus chunks; what is missing
    or null becomes the empty string.  Content must be there."""
    there = set(chunks.columns)
    if "content" not in there:
        raise ValueError("corpus chunks need the column content")
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in there else F.lit("")
    return chunks.select(F.col("content"), *(column(c).alias(c) for c in METADATA))


#: What stands for a missing value in a key; no text of a corpus holds it.
MISSING = "\x00null"


def sorted_items(m: Column) -> Column:
    """The entries of a map as an array of (key, value) in order of the keys."""
    return F.array_sort(F.map_entries(m))


def with_default(m: Column, key: str, default: Column) -> Column:
    """A map's value of a key, or the default where the map, the key or the value is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)


def updated(m: Column, other: Column) -> Column:
    """A map with another's entries in place of its own; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    m, other = F.coalesce(m, empty), F.coalesce(other, empty)
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k)), other)


def normalized(value: Column, kind: str | None = None) -> Column:
    """A metadata value as text: nested values (of a type that begins with
    array, struct or map) as JSON, a map's entries in order of their keys, and
    a mark for null."""
    if kind is not None and kind.startswith("map"):
        value, kind = sorted_items(value), "array"
    nested = kind is not None and kind.startswith(("array", "struct"))
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(MISSING))


def metadata_identity(docs: DataFrame, content: str, keys: Sequence[str]) -> Column:
    """identity() of a frame's columns, with their types."""
    kinds = dict(docs.dtypes)
    return identity(F.col(content), [(k, normalized(F.col(k), kinds[k])) for k in keys])


def chunks(articles: DataFrame, text: str, words: int = 200, overlap: int = 40) -> DataFrame:
    """Passages of at most `words` words of each article, each beginning
    `overlap` words before the last one ends; `chunk` numbers them from 0.  A
    blank article has none.  Other columns are kept."""
    if not 0 <= overlap < words:
        raise ValueError("the overlap must be less than a passage")
    step = words - overlap
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    rows = articles.withColumn("_words", split).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - overlap - 1, F.lit(0)), F.lit(step))
    rows = rows.withColumn("_start", F.explode(starts))
    passage = F.array_join(F.slice("_words", F.col("_start") + 1, F.lit(words)), " ")
    others = [c for c in articles.columns if c != text]
    return rows.select(*others, (F.col("_start") / step).cast("int").alias("chunk"), passage.alias(text))


#: Parts of a page that are no text, headings, and what else is between angle brackets.
NO_TEXT = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<nav\b.*?</nav>"
HEADING = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
TAG = r"(?s)<[^>]*>"
#: A sentence with what ends it, or the rest of a text.
SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[\"')\]]*\s*|[^.!?。！？]+")


def plain_text(html: Column) -> Column:
    """Without tags, white space collapsed; entities stay as they are."""
    return F.btrim(F.regexp_replace(F.regexp_replace(html, TAG, " "), r"[ \t\n\r]+", " "))


def sections(pages: DataFrame, html: str) -> DataFrame:
    """(…, section, heading, content): a page cut at its headings, in order; the
    part before the first has section 0 and an empty heading, and is left out if
    it is blank.  A null page has no sections.  Other columns are kept."""
    bare = F.regexp_replace(F.col(html), NO_TEXT, " ")
    rows = pages.withColumn("_bare", bare).where("_bare is not null")
    headings = F.concat(F.array(F.lit("")), F.regexp_extract_all("_bare", F.lit(HEADING), F.lit(1)))
    cut = F.arrays_zip(headings.alias("h"), F.split("_bare", HEADING).alias("c"))
    rows = rows.withColumn("_cut", cut).select(*(c for c in pages.columns if c != html), F.posexplode("_cut").alias("section", "_s"))
    rows = rows.withColumns({"heading": plain_text(F.col("_s.h")), "content": plain_text(F.col("_s.c"))}).drop("_s")
    return rows.where((F.col("section") > 0) | (F.col("content") != ""))


def packed(text: str, most: int) -> Iterator[str]:
    """Sentences one after the other, so many characters at most; a longer
    sentence is cut at words, a longer word where it must be."""
    held = ""
    for sentence in (m[0] for m in SENTENCE.finditer(text)):
        if len(held) + len(sentence.rstrip()) <= most:
            held += sentence
            continue
        if held.strip():
            yield held.strip()
        held = sentence
        while len(held.rstrip()) > most:
            at = held.rfind(" ", 1, most + 1)
            at = at if at > 0 else most
            yield held[:at].strip()
            held = held[at:].lstrip()
    if held.strip():
        yield held.strip()


@F.udtf(returnType="part int, passage string")
class Passages:
    """The passages of a text of so many characters at most, in order."""

    def eval(self, text: str, most: int):
        if most < 1:
            raise ValueError("a passage must have characters")
        yield from enumerate(packed(text or "", most))


def section_passages(pages: DataFrame, html: str, most: int = 1000) -> DataFrame:
    """(…, section, heading, part, passage): sections cut at sentences."""
    rows = sections(pages, html)
    return rows.lateralJoin(Passages(F.col("content").outer(), F.lit(most))).drop("content")


def identity(content: Column, metadata: Sequence[tuple[str, Column]]) -> Column:
    """A digest of content and metadata in order of the keys."""
    ordered = sorted(metadata, key=lambda kv: kv[0])
    parts = [x for k, v in ordered for x in (F.lit(k), normalized(v))]
    return F.sha2(F.concat_ws("\x1f", normalized(content), *parts), 256)


def last_wins(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """(doc_key, order, copies): for equal keys the last row in order."""
    return docs.groupBy(key.alias("doc_key")).agg(F.max(order).alias(order), F.count("*").alias("copies"))


def first_hits(hits: DataFrame, query: str, key: str, rank: str) -> DataFrame:
    """Each query's first hit of a key; later ones go."""
    best = Window.partitionBy(query, key).orderBy(rank)
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def union(corpora: dict[str, DataFrame], selected: Sequence[str] | None = None) -> DataFrame:
    """All rows of the selected corpora with their name in `corpus`; columns
    that one lacks are null there."""
    chosen = [n for n in corpora if selected is None or n in selected]
    if not chosen:
        raise ValueError("no corpus is selected")
    named = [corpora[n].withColumn("corpus", F.lit(n)) for n in chosen]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def source_counts(docs: DataFrame, source: str = "source") -> DataFrame:
    label = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown"))
    return docs.groupBy(label.alias("source")).agg(F.count("*").alias("documents"))


def corpus_summary(registry: DataFrame, combined: DataFrame) -> DataFrame:
    """(corpus, records, loaded) of every registered corpus, also missing ones."""
    counts = combined.groupBy("corpus").agg(F.count("*").alias("n"))
    joined = registry.select("corpus").join(counts, "corpus", "left")
    return joined.select("corpus", F.coalesce("n", F.lit(0)).alias("records"), F.col("n").isNotNull().alias("loaded"))


def with_ordinal(frame: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """A dense position from 0 in the order of a unique column.  Partitions of
    a range exchange are numbered by themselves and moved by the counts before,
    so no task sees all rows.  Their number is set, so that both uses of the
    exchange have the same partitions."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = frame.repartitionByRange(parts, F.col(order))
    spread = spread.withColumn("_p", F.spark_partition_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = starts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return spread.withColumn("_i", inside).join(starts, "_p").withColumn(name, F.col("_start") + F.col("_i") - 1).drop("_p", "_i", "_start")


def split(questions: DataFrame, dev: int, test: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """The column part: dev for the first `dev` rows, test for the next `test`
    (null or 0: all the rest); rows beyond go."""
    at = F.col(ordinal)
    inside = (at < dev) | F.lit(not test) | (at < dev + (test or 0))
    return questions.where(inside).withColumn("part", F.when(at < dev, "dev").otherwise("test"))


def sample(questions: DataFrame, dev: int, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The n rows after the first `dev`."""
    return questions.where((F.col(ordinal) >= dev) & (F.col(ordinal) < dev + n))
