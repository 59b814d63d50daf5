import random

from pyspark.sql import functions as F

from loomdex import queries
from loomdex.functions import dictionary, text
from loomdex.operators import rewriting

SF = "/root/testdata/sf0.001"


def rewritten(spark, asked, entries):
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    table = spark.createDataFrame(entries, "entry string, replacement string")
    return [r["rewritten"] for r in rewriting.rewrite(rows, table).orderBy("query_id").collect()]


def test_longest_match_and_what_is_left_alone(spark):
    entries = [("heart", "H"), ("heart attack", "infarction"), ("Attack  rate", "R"), ("rate", "r"), ("rate", "a"), ("x", None), (None, "y")]
    asked = ["Heart attack rate", "the heart-attack", "heart\n attack, RATE!", "hearts", "", None, "attack rate heart", "x heart"]
    assert rewritten(spark, asked, entries) == [
        "infarction a", "the H-attack", "infarction, a!", "hearts", "", None, "R H", "x H",
    ]
    assert rewritten(spark, ["No Entries"], [(None, None)]) == ["no entries"]


def test_equals_the_rewrites_of_whole_words(spark):
    """On the dictionary of abbreviations and the turns of the conversations."""
    turns = queries.asked_queries(spark, SF).withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
    entries = spark.createDataFrame([(k, f"{v} ({k})") for k, v in dictionary.ABBREVIATIONS], "entry string, replacement string")
    found = rewriting.rewrite(turns, entries).withColumn("want", text.expand_abbreviations("query", "word"))
    assert found.where("rewritten <> want").count() == 0 and found.where("rewritten <> lower(query)").count() > 3


def test_twenty_thousand_entries(spark):
    rng = random.Random(0)
    entries = [(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3]))), f"<{i}>") for i in range(20_000)]
    best = {}
    for entry, replacement in entries:
        best[entry] = min(best.get(entry, replacement), replacement)
    asked = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(200)]

    def plain(query):
        words, out, i = query.split(), [], 0
        while i < len(words):
            n = next((n for n in (3, 2, 1) if i + n <= len(words) and " ".join(words[i : i + n]) in best), 0)
            out.append(best[" ".join(words[i : i + n])] if n else words[i])
            i += max(1, n)
        return " ".join(out)

    assert rewritten(spark, asked, entries) == [plain(q) for q in asked]
