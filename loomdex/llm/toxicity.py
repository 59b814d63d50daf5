"""Toxicity by a weighted lexicon.  A text is folded (homoglyphs and styled
letters to plain ones, digit substitutions inside words to the letters they stand
for), reduced to its words, and matched by Aho-Corasick against whole words
and word stems.  A hit inside an exception phrase does not count.  The sum of
weights, also over the length, is calibrated to a chance of being toxic.

The lexicon, its weights and the exception phrases are learned from a bounded
sample of labelled rows.  Terms and word pairs are counted in Spark; only those
that can enter a lexicon reach the driver, and of each sampled text its four
numbers.  Three lexicons are learned side by side: of the whole sample, and of
either half of it for the calibration of the other half.  Copies of a text are
one text for the lexicons and are in the same half.

At most `lexicon_size` terms are kept, those that explain most; and a sum of
weights beyond `enough` counts as that in one of the four numbers.  With None,
neither is bounded; such a lexicon is as large as the sample makes it.

Defined results: a null or empty text has no hits; a null id is not held out; with labels of one class
only, every score is the smoothed class share; repeated rows score alike;
repeated ids give one sampled text each; an empty table gives no rows; texts
are read whole, in time linear in their length; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, slices
from .learn import Logistic, sample_rows

#: Bounds of the labelled sample that the lexicon is learned from.
SAMPLE_PER_CLASS = 4000
SAMPLE_LONGEST = 65_536
#: A term is kept if it is in this share of toxic documents (3 at least), with this log-odds weight.
LEAST_SHARE, LEAST_COUNT, LEAST_WEIGHT = 0.01, 3, 2.5
STEM_LENGTHS = (4, 5, 6)
LEXICON_SIZE = 2000
#: Tasks that the sample is dealt to.
SAMPLE_PARTITIONS = 48
#: A sum of weights beyond which more says nothing more.
ENOUGH = 25.0
#: A word pair around a term is an exception if so many clean documents hold it, and the share of toxic ones is lower.
EXCEPTION_COUNT = 3

# Letters that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁԛԝһвнкмтгпԍցνοραικτυхɑɡıℓ",
        "aeopcyxijsdqwhbhkmtrngqvopaiktuxagil",
        strict=True,
    )
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

SUBSTITUTED = re.compile(r"[013457@$!|]+(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")
FOLDS = str.maketrans(SUBSTITUTES)


class Folder(dict):
    """Code point to folded text, filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = unicodedata.normalize("NFKC", HOMOGLYPHS.get(char, char))
        plain = "".join(HOMOGLYPHS.get(c, c) for c in plain.lower())
        self[code] = plain
        return plain


FOLDER = Folder()


def unsubstituted(m: re.Match[str]) -> str:
    """Digits and signs between two letters become letters."""
    start = m.start()
    return m[0].translate(FOLDS) if start and m.string[start - 1].isalpha() else m[0]


def folded_words(text: str) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = low.translate(FOLDER)
    low = SUBSTITUTED.sub(unsubstituted, low)
    return WORD.findall(low)


def terms(words: set[str]) -> set[str]:
    """Whole words as " word " and longer words' stems as " stem"."""
    found = {f" {w} " for w in words}
    return found | {" " + w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: set[tuple[str, str]]
    calibration: Logistic | None = None
    enough: float | None = ENOUGH


class Matcher:
    def __init__(self, model: ToxicityModel):
        self.exceptions, self.enough = model.exceptions, model.enough
        self.found = ahocorasick.Automaton() if model.weights else None
        for term, weight in model.weights.items():
            self.found.add_word(term, (len(term), weight))
        if self.found is not None:
            self.found.make_automaton()

    def features(self, text: str) -> tuple[float, ...]:
        """The sum of weights by its logarithm, cut off, and by length; and the length."""
        words = folded_words(text)
        best: dict[int, float] = {}
        if self.found is not None:
            line = f" {' '.join(words)} "
            for end, (size, weight) in self.found.iter(line):
                start = end - size + 1
                if weight > best.get(start, 0.0):
                    best[start] = weight
            if best and self.exceptions:
                best = {s: w for s, w in best.items() if not self.excepted(line, s)}
        total = sum(best.values())
        most = total if self.enough is None else min(total, self.enough)
        return float(np.log1p(total)), most, total / (len(words) + 20), float(np.log1p(len(words)))

    def excepted(self, line: str, start: int) -> bool:
        """Whether the hit's word is in an exception phrase with a neighbour."""
        stop = line.index(" ", start + 1)
        word = line[start + 1 : stop]
        before = line[line.rfind(" ", 0, start) + 1 : start] if start else ""
        after = line[stop + 1 : line.find(" ", stop + 1)] if stop + 1 < len(line) else ""
        return (before, word) in self.exceptions or (word, after) in self.exceptions


#: The three lexicons: of the half 0, of the half 1, and of all texts.
FITS = (0, 1, 2)


@dataclass
class Sizes:
    """Distinct texts of a lexicon's sample."""

    toxic: int
    clean: int

    @property
    def least(self) -> float:
        return max(LEAST_COUNT, LEAST_SHARE * self.toxic)

    def weight(self, toxic: float, clean: float) -> float:
        """The log-odds of a term in so many toxic and clean texts."""
        return float(np.log((toxic + 0.5) / (self.toxic + 1)) - np.log((clean + 0.5) / (self.clean + 1)))

    def weight_of(self, toxic: Column, clean: Column) -> Column:
        return F.log((toxic + 0.5) / (self.toxic + 1)) - F.log((clean + 0.5) / (self.clean + 1))


def counted(sample: DataFrame, found, schema: str) -> DataFrame:
    """Applies a function of (fits, label, text) that gives keys; rows of the keys
    with their toxic and clean counts.  A task adds up what a slice of texts holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.replace(" string", "").replace(" int", "").split(", ")
        for part in slices(batches, "text"):
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for half, label, text in zip(*(part.column(c).to_pylist() for c in ("half", "label", "text"))):
                counts[label].update(found(half, text))
            keys = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([k[i] for k in keys], type=pa.int32() if name == "fit" else pa.string()) for i, name in enumerate(names)]
            sums = [pa.array([counts[label][k] for k in keys], type=pa.int64()) for label in (1, 0)]
            yield pa.RecordBatch.from_arrays([*columns, *sums], names=[*names, "toxic", "clean"])

    rows = sample.select("half", "label", "text").mapInArrow(run, f"{schema}, toxic long, clean long")
    keys = [x.split()[0] for x in schema.split(", ")]
    return rows.groupBy(*keys).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fits_of(half: int) -> tuple[int, int]:
    """The lexicons that a text of this half is counted for."""
    return half, 2


def learned_weights(sample: DataFrame, sizes: dict[int, Sizes], lexicon_size: int | None = LEXICON_SIZE) -> dict[int, dict[str, float]]:
    """The terms and weights of each lexicon."""

    def found(half: int, text: str) -> list[tuple[int, str]]:
        own = terms(set(folded_words(text)))
        return [(fit, t) for fit in fits_of(half) for t in own]

    rows = counted(sample, found, "fit int, term string")
    enough = F.lit(False)
    for fit, size in sizes.items():
        # A hair below the bound, which is decided on the driver.
        heavy = size.weight_of(F.col("toxic"), F.col("clean")) >= LEAST_WEIGHT - 1e-6
        enough = enough | ((F.col("fit") == fit) & (F.col("toxic") >= size.least) & heavy)
    out: dict[int, dict[str, float]] = {}
    counts: dict[int, dict[str, int]] = {fit: {} for fit in FITS}
    weights: dict[int, dict[str, float]] = {fit: {} for fit in FITS}
    for r in rows.where(enough).collect():
        weight = sizes[r["fit"]].weight(r["toxic"], r["clean"])
        if weight >= LEAST_WEIGHT:
            weights[r["fit"]][r["term"]] = weight
            counts[r["fit"]][r["term"]] = r["toxic"]
    for fit, own in weights.items():
        # A term adds nothing beside a shorter stem of at least its weight.
        for t in sorted(own, key=lambda t: (-len(t), t)):
            if any(own.get(t[: n + 1], -1.0) >= own[t] for n in STEM_LENGTHS if n + 1 < len(t)):
                del own[t]
        kept = sorted(own, key=lambda t: (-own[t] * counts[fit][t], t))[:lexicon_size]
        out[fit] = {t: own[t] for t in kept}
    return out


def learned_exceptions(sample: DataFrame, sizes: dict[int, Sizes], weights: dict[int, dict[str, float]]) -> dict[int, set[tuple[str, str]]]:
    """The word pairs with a hit that clean texts hold more often."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def found(half: int, text: str) -> set[tuple[int, str, str]]:
        words, out = folded_words(text), set()
        for fit in fits_of(half):
            own = shared.value[fit]
            hit = {w for w in set(words) if f" {w} " in own or any(" " + w[:n] in own for n in STEM_LENGTHS)}
            if hit:
                out |= {(fit, a, b) for a, b in zip(words, words[1:]) if a in hit or b in hit}
        return out

    rows = counted(sample, found, "fit int, a string, b string").where(F.col("clean") >= EXCEPTION_COUNT)
    out: dict[int, set[tuple[str, str]]] = {fit: set() for fit in FITS}
    cleaner = F.lit(False)
    for fit, size in sizes.items():
        more = F.col("clean") / max(size.clean, 1) > F.col("toxic") / max(size.toxic, 1)
        cleaner = cleaner | ((F.col("fit") == fit) & more)
    for r in rows.where(cleaner).collect():
        out[r["fit"]].add((r["a"], r["b"]))
    return out


def calibration_rows(sample: DataFrame, models: dict[int, ToxicityModel]) -> list:
    """(label, copies, features) of each sampled text under the lexicon of the other half."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {half: Matcher(shared.value[1 - half]) for half in (0, 1)}
        for part in slices(batches, "text"):
            halves, texts = (part.column(c).to_pylist() for c in ("half", "text"))
            made = [matchers[h].features(t) for h, t in zip(halves, texts)]
            features = pa.array(made, type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("copies"), features], names=["label", "copies", "features"])

    rows = sample.mapInArrow(run, "label int, copies long, features array<double>")
    return sorted((r["label"], tuple(r["features"]), r["copies"]) for r in rows.collect())


def fit(
    docs: DataFrame,
    marks: DataFrame,
    scratch: Scratch | None = None,
    per_class: int = SAMPLE_PER_CLASS,
    longest: int = SAMPLE_LONGEST,
    lexicon_size: int | None = LEXICON_SIZE,
    enough: float | None = ENOUGH,
) -> ToxicityModel:
    """From documents and their marks (doc_id, label)."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    rows, counts = sample_rows(docs, marks, per_class, longest)
    distinct = rows.groupBy("label", "text").agg(F.count("*").alias("copies"))
    distinct = distinct.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    # One or two texts a partition would be too few, but a sample is small: the tasks are dealt by text.
    sample = scratch.write(distinct.repartition(SAMPLE_PARTITIONS, "text"), "sample")
    held = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    size = lambda halves: Sizes(*(sum(held.get((h, label), 0) for h in halves) for label in (1, 0)))
    sizes = {0: size([0]), 1: size([1]), 2: size([0, 1])}
    weights = learned_weights(sample, sizes, lexicon_size)
    exceptions = learned_exceptions(sample, sizes, weights)
    models = {f: ToxicityModel(weights[f], exceptions[f], enough=enough) for f in FITS}
    found = calibration_rows(sample, models)
    scratch.drop(sample)
    features = np.repeat(np.array([f for _, f, _ in found]).reshape(-1, 4), [n for *_, n in found], axis=0)
    labels = np.repeat([float(label) for label, *_ in found], [n for *_, n in found])
    models[2].calibration = Logistic(features, labels, counts)
    return models[2]


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and the column score; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        matcher = Matcher(shared.value)

        def run(texts: list[str]):
            found = shared.value.calibration.scores(np.array([matcher.features(t) for t in texts]))
            return ((float(s),) for s in found)

        return run

    return map_rows(docs, make, pa.schema([("score", pa.float64())]), "score double", keep, text)


def scored_documents(docs: DataFrame, model: ToxicityModel, fold: int, held_out: int, threshold: float) -> DataFrame:
    found = score(docs, model, ["doc_id"])
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
