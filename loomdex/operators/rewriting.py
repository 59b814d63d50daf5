"""Rewriting of queries by a dictionary that is a table.

Entries of any number are found by a join: the runs of words of a query, up to
the longest entry, meet the entries by equality.  The leftmost of the longest
matches hold; what they cover is not matched again, nor is a replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and what lies between them, in turn.
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
WORD, SPACE = r"^[\p{L}\p{N}_]", r"^\s+$"


def normalized(entry):
    """An entry as it is looked up: lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(entry, r"\s+", " ")))


def rewrite(queries: DataFrame, entries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """queries with `rewritten`: lower-cased, where each whole word or run of
    words that is an entry (entry, replacement) is replaced.  Words of an entry
    may stand apart by any white space.  Of equal entries the least replacement
    holds; a null query stays null; ids are unique, and a null one is not rewritten."""
    table = entries.where("entry is not null and replacement is not null").groupBy(normalized(F.col("entry")).alias("key")).agg(F.min("replacement").alias("replacement"))
    longest = table.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0
    pieces = F.regexp_extract_all(F.lower(F.col(query)), F.lit(PIECES), F.lit(0))
    cut = queries.select(F.col(query_id).alias("_id"), pieces.alias("_pieces"))
    runs = cut.where("_id is not null").select("_id", "_pieces", F.posexplode("_pieces").alias("start", "first")).where(F.col("first").rlike(WORD))
    # A run of n words has n - 1 gaps between them.
    sizes = F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), F.floor((F.size("_pieces") - F.col("start") + 1) / 2).cast("int")))
    runs = runs.select("_id", "start", F.explode(sizes).alias("n"), "_pieces")
    run = F.slice("_pieces", F.col("start") + 1, 2 * F.col("n") - 1)
    gaps = F.filter(run, lambda x, i: i % 2 == 1)
    words = F.array_join(F.filter(run, lambda x, i: i % 2 == 0), " ")
    keyed = runs.where(F.forall(gaps, lambda x: x.rlike(SPACE))).select("_id", "start", "n", words.alias("key"))
    match = F.struct("start", (-F.col("n")).alias("less"), "replacement")
    found = keyed.join(table, "key").groupBy("_id").agg(F.array_sort(F.collect_list(match)).alias("_matches"))
    # From left to right, a match holds if it begins after the last one that held.
    none = F.expr("cast(array() as array<struct<start: int, less: int, replacement: string>>)")
    held = F.aggregate(
        "_matches",
        F.struct(F.lit(0).alias("end"), none.alias("held")),
        lambda s, m: F.when(
            m["start"] >= s["end"], F.struct((m["start"] - 2 * m["less"] - 1).alias("end"), F.concat(s["held"], F.array(m)).alias("held"))
        ).otherwise(s),
        lambda s: s["held"],
    )
    found = found.select("_id", held.alias("_held"))

    def piece(x, i):
        """The replacement where a match begins, nothing where one goes on."""
        begins = F.element_at(F.filter("_held", lambda m: m["start"] == i), 1)
        covered = F.exists("_held", lambda m: (m["start"] < i) & (i < m["start"] - 2 * m["less"] - 1))
        starts = F.exists("_held", lambda m: m["start"] == i)
        return F.when(starts, begins["replacement"]).when(covered, F.lit("")).otherwise(x)

    rows = queries.withColumns({"_id": F.col(query_id), "_pieces": pieces}).join(found, "_id", "left")
    changed = F.array_join(F.transform("_pieces", piece), "")
    return rows.withColumn("rewritten", F.when(F.col("_held").isNull(), F.lower(F.col(query))).otherwise(changed)).drop("_id", "_pieces", "_held")
