"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only.

A line, trimmed of white space, goes if an earlier line (by document id, then
place) equals it or is within one edit of it.  Two lines within one edit agree
outside one block: with s the shorter length cut into blocks, they have the
same prefix before some block and the same suffix after it.

1. Lines whose half before or after the middle (two blocks) occurs in no other line
   have no neighbour; the others are kept with their texts.
2. Those are cut into blocks of about BLOCK_CHARS.  Where a block's
   surroundings occur in another line too, all variants of the line with a
   character of that block deleted are emitted as hashed keys.
3. Equal variants are joined.  Lines that lose the same place to one variant
   differ in that place only, and a line that equals a variant of another is
   one character shorter; so each variant's earliest line is all that its
   others need to meet, and no variant's lines are paired with each other.
4. The edit distance of each such pair is verified.

All steps take time linear in a line's length.

Only (document, place) of lines that go are joined back to the documents.

Defined results: null texts stay null; lines shorter than `min_chars` after
trimming, blank ones too, always stay; rows with a null id take no part;
repeated rows of one document are one document and stay alike; lines and texts
of any length are compared whole; an empty table gives no rows; other columns,
whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, hot_join

#: Lines below this length are too short to compare.
MIN_CHARS = 12
#: Length of a block in the second step.
BLOCK_CHARS = 32
#: More than a document has lines.
PLACES = 2**31
#: Least and most bits of a filter of lines or keys: half a megabyte and eight.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 22, 1 << 26

TRIMMED = " \t\x0b\x0c\r"


def lines_of(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pos, line, id): the trimmed lines that are long enough, with
    a 128-bit digest."""
    # An outer explode: for an inner one, a filter is inferred that splits every text again.
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.split(F.col(text), "\n", -1)).alias("pos", "raw")
    )
    rows = rows.select("doc_id", "pos", F.btrim("raw", F.lit(TRIMMED)).alias("line"))
    rows = rows.where(F.length("line") >= min_chars)
    return rows.withColumn("id", F.unhex(F.md5("line")))


def half_keys(line: Column) -> Column:
    """The four keys of a line: what lies around either half, with the line as
    the shorter and as the longer of two."""
    length = F.length(line)

    def key(s: Column, j: int) -> Column:
        cut = F.floor(s / 2).cast("int")
        other = F.substring(line, length - cut + 1, cut) if j == 0 else F.substring(line, F.lit(1), cut)
        return F.xxhash64(s, F.lit(j), other)

    return F.array(*(key(length - less, j) for less in (0, 1) for j in (0, 1)))


def block_chars(s: Column) -> Column:
    """Characters of a block when the shorter length is s; there are two blocks at least."""
    return F.when(s > 2 * BLOCK_CHARS, F.lit(BLOCK_CHARS)).otherwise(F.ceil(s / 2)).cast("int")


def block_rows(lines: DataFrame) -> DataFrame:
    """(id, s, j, key) of lines (id, line, length), each as the shorter and as
    the longer of two.  The key tells the shorter length s, the place j of a
    block, and all that lies around it: the blocks before it, counted from the
    start of the line, and those after it, from its end.  Each block is hashed
    with its place, and the hashes are added up by exclusive or, so the work
    is linear in a line's length."""

    def rows(less: int) -> DataFrame:
        s = F.col("length") - less
        size = block_chars(s)
        pattern = F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}"))
        cut = lambda text: F.regexp_extract_all(text, pattern, F.lit(0))
        hashed = lambda blocks: F.transform(blocks, lambda x, i: F.xxhash64(i, x))
        left = hashed(F.slice(cut("line"), F.lit(1), F.ceil(s / size).cast("int")))
        right = hashed(cut(F.substring(F.col("line"), F.lit(1 + less), F.col("length"))))
        found = lines.select("id", s.alias("s"), F.posexplode(F.arrays_zip(left.alias("l"), right.alias("r"))).alias("j", "b"))
        return found.select("id", "s", "j", "b.l", "b.r")

    # Of these frames each takes one pass; one that ends with the last row would take one for each row.
    place = Window.partitionBy("id", "s").orderBy("j")
    so_far, whole = (place.rowsBetween(Window.unboundedPreceding, x) for x in (0, Window.unboundedFollowing))
    before = F.bit_xor("l").over(so_far).bitwiseXOR(F.col("l"))
    after = F.bit_xor("r").over(whole).bitwiseXOR(F.bit_xor("r").over(so_far))
    both = rows(0).unionByName(rows(1))
    return both.select("id", "s", "j", F.xxhash64("s", "j", before, after).alias("key"))


def cell(value: Column, bits: int) -> Column:
    """A value's cell in a filter."""
    return F.pmod(F.xxhash64(value, F.lit(11)), F.lit(bits))


def filtered(rows: DataFrame, column: str, values: DataFrame, of: str | None = None) -> DataFrame:
    """Rows whose value may be among those of a column of a written table, told
    by a bitmap in one broadcast row.  Its size follows the count of values;
    with more than MOST_FILTER_BITS would serve, all rows pass.  What passes by
    mistake costs only work, as a join follows."""
    bits = max(LEAST_FILTER_BITS, 1 << (8 * values.count()).bit_length())
    if bits > MOST_FILTER_BITS:
        return rows
    at = cell(F.col(of or column), bits)
    hit = values.select(F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))
    words = hit.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = values.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    bitmap = filled.agg(F.transform(ordered, lambda x: x["bits"]).alias("filter"))
    own = cell(F.col(column), bits)
    found = F.getbit(F.element_at("filter", (F.floor(own / 64) + 1).cast("int")), (own % 64).cast("int")) == 1
    return rows.join(F.broadcast(bitmap), found).select(*rows.columns)


def lines_with_shared_keys(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(line) of the rows (line, key), both long, whose key another line has
    too.  A key of two lines names both; only keys of more are joined back."""
    ends = keyed.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("n"))
    ends = scratch.write(ends.where("low < high"), "ends")
    two = ends.select(F.explode(F.array("low", "high")).alias("line"))
    more = scratch.write(ends.where("n > 2").select("key", "n"), "more")
    rest = hot_join(filtered(keyed, "key", more), more, "key", "n", F.col("line")).select("line")
    return two.union(rest).distinct()


def block_bounds() -> tuple[Column, Column]:
    """Where block j of the shorter length s begins and ends."""
    size = block_chars(F.col("s"))
    return F.col("j") * size, F.least((F.col("j") + 1) * size, F.col("s"))


def variants(matched: DataFrame) -> DataFrame:
    """(id, first, s, j, variant, whole): the deletion neighbourhood of the matched
    block of each line.  The place of the deletion is part of the variant where
    both lines lose a character; `whole` marks a line that lost none."""
    begin, end = block_bounds()
    longer = F.col("length") - F.col("s")
    cut = matched.withColumn("middle", F.substring("line", begin + 1, end - begin + longer))
    cut = cut.drop("line").withColumn("longer", longer)
    places = F.sequence(F.lit(1), F.length("middle"))
    lost = lambda p: F.concat(F.substring("middle", F.lit(1), p - 1), F.substring("middle", p + 1, F.lit(2**30)))
    hashed = lambda kind, p, text: F.xxhash64("key", F.lit(kind), p, text)
    same = F.transform(places, lambda p: F.struct(hashed("same", p, lost(p)).alias("variant"), F.lit(None).cast("boolean").alias("whole")))
    shorter = F.array(F.struct(hashed("gap", F.lit(0), F.col("middle")).alias("variant"), F.lit(True).alias("whole")))
    gaps = F.transform(places, lambda p: F.struct(hashed("gap", F.lit(0), lost(p)).alias("variant"), F.lit(False).alias("whole")))
    found = F.when(F.col("longer") == 0, F.concat(same, shorter)).otherwise(F.array_distinct(gaps))
    return cut.select("id", "first", "s", "j", F.explode(found).alias("v")).select("id", "first", "s", "j", "v.variant", "v.whole")


def near_lines(docs: DataFrame, distinct: DataFrame, scratch: Scratch, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(id) of distinct lines that are within one edit of an earlier one."""
    number = F.xxhash64("id").alias("line")  # a short name of a line, where a mistake costs only work
    keyed = distinct.select(number, F.explode("halves").alias("key"))
    numbers = lines_with_shared_keys(keyed, scratch)
    open_ids = distinct.select("id", "first", number).join(numbers, "line").select("id", "first")
    open_ids = scratch.write(open_ids, "open")
    # Only documents that hold an open line for the first time are split again.
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = filtered(held, "doc_id", open_ids.select(F.col("first.doc_id").alias("holder")), "holder")
    rows = filtered(lines_of(held, min_chars, "doc_id", "text"), "id", open_ids).join(open_ids, "id")
    rows = rows.where((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.pos") == F.col("pos")))
    rows = scratch.write(rows.dropDuplicates(["id"]).select("id", "first", "line", F.length("line").alias("length")), "texts")
    blocks = scratch.write(block_rows(rows.select("id", "line", "length")), "blocks")
    shared = blocks.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    matched = blocks.join(shared, "key").join(rows, "id")
    emitted = scratch.write(variants(matched), "variants")
    bests = emitted.groupBy("variant").agg(
        F.count("*").alias("lines"),
        F.min_by("id", F.struct("first")).alias("best_best"),
        F.min("first").alias("best_first"),
        F.min_by("id", F.when(F.col("whole"), F.col("first"))).alias("whole_best"),
        F.min(F.when(F.col("whole"), F.col("first"))).alias("whole_first"),
        F.min_by("id", F.when(~F.col("whole"), F.col("first"))).alias("cut_best"),
        F.min(F.when(~F.col("whole"), F.col("first"))).alias("cut_first"),
    ).where("lines > 1")
    # A variant has no more lines than there are characters that one place can hold.
    met = emitted.join(bests, "variant")
    # A whole line meets the cut ones and these the whole one; where both lost the same place, all meet.
    meets = lambda which: F.struct(F.col(f"{which}_first").alias("first"), F.col(f"{which}_best").alias("other"), "s", "j")
    partner = F.when(F.col("whole").isNull(), meets("best")).when(F.col("whole"), meets("cut")).otherwise(meets("whole"))
    met = met.withColumn("partner", partner).where("partner.first < first")
    pairs = met.groupBy("id").agg(F.min("partner").alias("p")).select("id", "p.other", "p.s", "p.j")
    side = lambda a, b: rows.select(F.col("id").alias(a), F.col("line").alias(b))
    known = pairs.join(side("id", "line"), "id").join(side("other", "other_line"), "other")
    return known.where(within_one_edit("line", "other_line")).select("id")


def within_one_edit(a: str, b: str) -> Column:
    """Whether two lines are equal around block j of the shorter length s, and
    within one edit inside it.  (The edit distance of whole lines would take
    time in the square of their length.)"""
    begin, end = block_bounds()
    rest = F.col("s") - end
    before = lambda x: F.substring(F.col(x), F.lit(1), begin)
    middle = lambda x: F.substring(F.col(x), begin + 1, F.length(x) - begin - rest)
    after = lambda x: F.substring(F.col(x), F.length(x) - rest + 1, rest)
    return (before(a) == before(b)) & (after(a) == after(b)) & F.levenshtein(middle(a), middle(b), 1).between(0, 1)


def removed_lines(
    docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, removed): the places of the lines that go, in order, of each
    document that loses any."""
    rows = lines_of(docs, min_chars, doc_id, text).withColumn("halves", half_keys(F.col("line")))
    # Document and place as one number: its least can be kept in a hash aggregation, a struct's cannot.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos").cast("decimal(10,0)")
    distinct = rows.groupBy("id").agg(
        F.min(place).alias("place"),
        F.count("*").alias("times"),
        *(F.min(F.col("halves")[i]).alias(f"k{i}") for i in range(4)),
    )
    at = F.pmod("place", F.lit(PLACES).cast("decimal(11,0)"))
    holder = (F.col("place") - at) / F.lit(PLACES).cast("decimal(11,0)")
    kind = docs.schema[doc_id].dataType
    first = F.struct(holder.cast(kind).alias("doc_id"), at.cast("int").alias("pos")).alias("first")
    distinct = distinct.select("id", first, "times", F.array(*(f"k{i}" for i in range(4))).alias("halves"))
    distinct = scratch.write(distinct, "distinct")
    near = scratch.write(near_lines(docs, distinct, scratch, min_chars, doc_id, text), "near").withColumn("near", F.lit(True))
    flagged = distinct.select("id", "first", "times").join(near, "id", "left")
    kept = flagged.where("near or times > 1")
    flagged = scratch.write(kept.select("id", "first", "times", F.coalesce("near", F.lit(False)).alias("near")), "flagged")
    scratch.drop_all_but(flagged)
    again = filtered(lines_of(docs, min_chars, doc_id, text).select("doc_id", "pos", "id"), "id", flagged)
    again = hot_join(again, flagged, "id", "times", F.col("doc_id"))
    gone = again.where(F.col("near") | (F.struct("doc_id", "pos") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def cleaned(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text, n_lines, n_removed) of each row of docs: its other
    columns, and the text that stays."""
    # Split before the join, so that the lambda below refers to a column and not to the split.
    others = F.struct(*(F.col(c) for c in docs.columns if c != text), F.lit(0).alias("_"))
    cut = docs.select(others.alias("row"), F.col(doc_id).alias("doc_id"), F.split(F.col(text), "\n", -1).alias("lines"))
    rows = cut.join(removed.select("doc_id", "removed").hint("merge"), "doc_id", "left")
    gone = F.concat(F.array(F.lit(-1)), F.col("removed"), F.array(F.size("lines")))
    starts = F.slice(gone, 1, F.size(gone) - 1)
    stays = F.flatten(
        F.zip_with(starts, F.slice(gone, 2, F.size(gone)), lambda a, b: F.slice("lines", a + 2, b - a - 1))
    )
    return rows.select(
        "row",
        "doc_id",
        F.array_join(F.when(F.col("removed").isNull(), F.col("lines")).otherwise(stays), "\n").alias("text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def deduplicated(
    docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", chars: str = "n_chars"
) -> DataFrame:
    """docs, with all their columns, without the lines that go and without the
    documents that this leaves blank; `chars`, if there, is counted anew."""
    removed = scratch.write(removed_lines(docs, scratch, min_chars, doc_id, text), "removed")
    rows = cleaned(docs, removed, doc_id, text)
    changed = F.col("n_removed") > 0
    rows = rows.where(~changed | (F.length(F.btrim("text", F.lit(TRIMMED + "\n"))) > 0))

    def column(c: str) -> Column:
        if c == text:
            return F.col("text").alias(c)
        if c == chars:
            count = F.length("text").cast(docs.schema[chars].dataType)
            return F.when(changed, count).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return rows.select(*map(column, docs.columns))


def digests(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that stays."""
    own = docs.select("doc_id", "text")
    kept = cleaned(own, scratch.write(removed_lines(own, scratch, min_chars), "removed"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", digest)
