"""Fill-in-the-middle transformation by escaped marker injection, with DataFrame
functions only.

A text is cut into units, each a word with the white space before it, or the
white space at the end.

1. MARK and ESCAPE inside the text are escaped, so that MARK occurs nowhere.
   Neither is white space, so the units of the escaped text are those of the text.
2. `regexp_replace` appends MARK after each unit; the units are counted by it.
3. Two draws of the document's id give the ranks of two cuts.
4. `substring_index` by rank takes the parts before, between and after the cuts.
5. MARK is taken out of the parts, they are unescaped and put in order.

`restored` takes the text back out of what step 5 gives and its form.

A row needs nothing but itself, so there is no exchange, and every step takes
time linear in the text's length.

Defined results: a null text is an empty one; an empty text, one that holds one
of the three sentinels, and one that the draw leaves out stay as they are
("plain"), without lengths of parts; a null id draws like an id without digits;
repeated rows stay and are alike; an empty table gives no rows; other columns,
whatever their names, do not matter, and `transformed` keeps them in `row`.
Any part may be empty.  Texts of any length are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks the end of a unit, and says that the letter after it stands for one of the two.
MARK, ESCAPE = "\x01", "\x02"
MARK_NAME, ESCAPE_NAME = "m", "e"
#: A word with the white space before it, or white space that no word follows.
#: The quantifiers give nothing back, which changes no match and keeps the time linear.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


@dataclass(frozen=True)
class Settings:
    """The seed of the draws, the percentages of texts that are transformed and,
    of these, of those that begin with the suffix, and the sentinels."""

    seed: int = 42
    percent: int = 50
    suffix_first_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def escaped(text: Column) -> Column:
    once = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_NAME))
    return F.replace(once, F.lit(MARK), F.lit(ESCAPE + MARK_NAME))


def unescaped(text: Column) -> Column:
    """The text of some units: without the marks that end them."""
    once = F.replace(text, F.lit(MARK), F.lit(""))
    once = F.replace(once, F.lit(ESCAPE + MARK_NAME), F.lit(MARK))
    return F.replace(once, F.lit(ESCAPE + ESCAPE_NAME), F.lit(ESCAPE))


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def first_units(marked: str, rank: str) -> Column:
    """Of a marked text, the first so many units; the last of them without its mark."""
    return F.expr(f"substring_index({marked}, '\\u0001', {rank})")


def last_units(marked: str, all_units: str, rank: str) -> Column:
    """Of a marked text of so many units, those after the first so many.  A text
    of n units has n marks, and so n + 1 pieces, the last of which is empty."""
    return F.expr(f"substring_index({marked}, '\\u0001', -({all_units} - {rank} + 1))")


def transformed(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) of each row of docs:
    its other columns, the number of units, and the text in its new form."""
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(0).alias("_")).alias("row"),
        F.coalesce(F.col(text), F.lit("")).alias("whole"),
        *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col(doc_id), settings.seed), 1)),
    )
    untouched = (F.col("whole") == "") | (F.col("h3") % 100 >= settings.percent)
    for sentinel in settings.sentinels:
        untouched |= F.contains("whole", F.lit(sentinel))
    suffix_first = F.col("h4") % 100 < settings.suffix_first_percent
    form = F.when(untouched, F.lit("plain")).when(suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    own = own.select("row", "whole", "h1", "h2", form.alias("form"), escaped(F.col("whole")).alias("safe"))
    own = own.withColumn("marked", F.regexp_replace("safe", UNIT, f"$0{MARK}"))
    # A mark is one byte, and only marks were added.
    own = own.withColumn("n", (F.octet_length("marked") - F.octet_length("safe")).cast("long"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    own = own.withColumns({"low": F.least(*cuts).cast("int"), "high": F.greatest(*cuts).cast("int"), "units": F.col("n").cast("int")})
    # The three parts are taken of texts that have them only.
    cut = F.col("form") != "plain"
    own = own.withColumns(
        {
            "before": F.when(cut, first_units("marked", "low")),
            "head": F.when(cut, first_units("marked", "high")),
            "after": F.when(cut, last_units("marked", "units", "high")),
        }
    )
    between = F.expr("substring_index(head, '\\u0001', low - high)")
    own = own.withColumn("between", F.when(F.col("low") == F.col("high"), F.lit("")).otherwise(between))
    parts = {name: unescaped(F.col(name)) for name in ("before", "between", "after")}
    own = own.select("row", "whole", "n", "form", *(c.alias(name) for name, c in parts.items()))
    p, s, m = (F.lit(x) for x in settings.sentinels)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "before", s, "after", m, "between"))
        .when(F.col("form") == "spm", F.concat(s, "after", p, "before", m, "between"))
        .otherwise(F.col("whole"))
    )
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return own.select("row", "n", "form", chars("before").alias("prefix_chars"), chars("between").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that was transformed.  A text that was cut held no sentinel, and
    parts cannot make one with a sentinel beside them, so each occurs once."""
    p, s, m = settings.sentinels
    until = lambda end, c=output: F.substring_index(c, end, 1)
    since = lambda start, c=output: F.substring_index(c, start, -1)
    psm = F.concat(since(p, until(s)), since(m), since(s, until(m)))
    spm = F.concat(since(p, until(m)), since(m), since(s, until(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output
    and of the text restored from it."""
    found = transformed(docs.select("doc_id", "text"), settings)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), settings), 256).alias("restored_sha256"),
    )
