"""Column functions over questions, options, contexts and model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import ABBREVIATIONS, CHINESE_TERMS, SYNONYMS

#: A word, in every regular expression dialect that is used here.
TOKEN = r"[\p{L}\p{N}_]+"
#: Options shown when a question has none.
NO_OPTIONS = "A. Not provided\nB. Not provided\nC. Not provided\nD. Not provided"
#: How a failed generation's text begins.
ERROR_PREFIX = "Error generating answer:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Lower-cased words; null stays null."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def correct_letter(answer_index: Column | str, answer: Column | str) -> Column:
    """The letter of a question's key: by index, else the answer upper-cased."""
    index = F.coalesce(_col(answer_index), F.lit(-1))
    return F.when(index >= 0, F.chr(F.lit(65) + index)).otherwise(F.upper(F.coalesce(_col(answer).cast("string"), F.lit(""))))


def extract_answer(response: Column | str) -> Column:
    """The option letter that a response states, or null.  Phrases count by
    their first match in either case, marked letters by the last, then the
    last letter A-E that is a word by itself."""
    text = _col(response)
    first = lambda p: F.upper(F.nullif(F.regexp_extract(text, p, 1), F.lit("")))
    last = lambda p: F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1))
    alone = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: w.rlike("^[A-E]$"))
    return F.coalesce(
        first(r"(?iU)answer\s*[:：]\s*([A-E])"),
        first(r"(?iU)correct\s*option\s*is\s*([A-E])"),
        last(r"\*\*([A-E])\*\*"),
        last(r"\(([A-E])\)"),
        last(r"\[([A-E])\]"),
        F.try_element_at(alone, F.lit(-1)),
    )


def format_options(options: Column | str) -> Column:
    """`A. x` lines; null or no options give the four placeholder lines."""
    given = _col(options)
    lines = F.transform(given, lambda x, i: F.concat(F.chr(F.lit(65) + i), F.lit(". "), F.coalesce(x, F.lit("None"))))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_OPTIONS))


def render_contexts(passages: Column | str) -> Column:
    """`[i] text` blocks of an array of passages in rank order."""
    numbered = F.transform(_col(passages), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return F.array_join(numbered, "\n\n")


# The wording of the evaluation prompt.
ROLE = "You are a medical expert assistant."
WITH_CONTEXT = (
    "Answer the following question based on the provided context. "
    "If the context does not contain enough information to answer the question, "
    "state that you cannot answer based on the given information."
)
WITHOUT_CONTEXT = "Answer the following question based on your medical knowledge."
CLOSING = ["Provide only the final answer in the following format:", "Answer: [A/B/C/D/E]", "", "Your response:"]


def build_prompt(question: Column | str, options: Column | str, context: Column | str | None = None) -> Column:
    """The prompt; a null or empty context gives the one without retrieval."""
    tail = F.concat(
        F.lit("\n\nQuestion: "), F.coalesce(_col(question), F.lit("")),
        F.lit("\n\nOptions:\n"), format_options(options), F.lit("\n\n" + "\n".join(CLOSING)),
    )
    plain = F.concat(F.lit(f"{ROLE}\n{WITHOUT_CONTEXT}"), tail)
    if context is None:
        return plain
    own = _col(context)
    held = F.concat(F.lit(f"{ROLE}\n{WITH_CONTEXT}\n\nContext:\n"), own, tail)
    return F.when(F.coalesce(own, F.lit("")) != "", held).otherwise(plain)


def _entries(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs))


def expand_abbreviations(query: Column | str, mode: str = "substring") -> Column:
    """Each abbreviation becomes `full form (abbreviation)`, in dictionary
    order, on lower-cased text.  Whether one is present is asked of the
    original.  `substring` also finds them inside words; `word` does not."""
    lowered = F.lower(_col(query))
    if mode == "word":
        out = lowered
        for k, v in ABBREVIATIONS:
            out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_(]){k}(?![\p{{L}}\p{{N}}_])", f"{v} ({k})")
        return out
    if mode != "substring":
        raise ValueError(f"unknown mode {mode!r}")
    # A fold of one small lambda: nested conditions would double the expression with every entry.
    return F.aggregate(
        _entries(ABBREVIATIONS),
        lowered,
        lambda out, e: F.when(F.contains(lowered, e["k"]), F.replace(out, e["k"], F.concat(e["v"], F.lit(" ("), e["k"], F.lit(")")))).otherwise(out),
    )


def replace_synonyms(query: Column | str) -> Column:
    """Common terms become clinical ones, one after the other, on lower-cased text."""
    out = F.lower(_col(query))
    for k, v in SYNONYMS:
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def expand_chinese_terms(query: Column | str) -> Column:
    """Short Chinese terms become `full (short)`, one after the other."""
    out = _col(query)
    for k, v in CHINESE_TERMS:
        out = F.replace(out, F.lit(k), F.lit(f"{v} ({k})"))
    return out


REWRITES = {"abbreviations": expand_abbreviations, "synonyms": replace_synonyms, "chinese": expand_chinese_terms}


def dictionary_rewrite(query: Column | str, strategies: Sequence[str] = tuple(REWRITES)) -> Column:
    """The chosen rewrites, always in the order of the table above."""
    if unknown := set(strategies) - set(REWRITES):
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    out = _col(query)
    for name, rewrite in REWRITES.items():
        if name in strategies:
            out = rewrite(out)
    return out


def needs_model_rewrite(
    query: Column | str, enabled: bool = True, mode: str = "auto", max_chars: int = 160, max_words: int = 24
) -> Column:
    """Whether a query is worth a call to the rewriting model: never if off or
    blank; always with Chinese characters or an abbreviation as a word; else
    if it is short in characters and words."""
    if not enabled or mode == "never":
        return F.lit(False)
    if mode == "always":
        return F.lit(True)
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    text = F.regexp_replace(F.coalesce(_col(query), F.lit("")), r"(?U)^\s+|\s+$", "")
    abbreviations = "|".join(k for k, _ in ABBREVIATIONS)
    return (
        F.when(text == "", F.lit(False))
        .when(text.rlike(r"[\x{4e00}-\x{9fff}]"), F.lit(True))
        .when(F.lower(text).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({abbreviations})([^\p{{L}}\p{{N}}_]|$)"), F.lit(True))
        .when(F.length(text) > max_chars, F.lit(False))
        .when(F.size(F.split(text, r"(?U)\s+")) > max_words, F.lit(False))
        .otherwise(F.lit(True))
    )


# Fixed value: the wording of the rewriting prompt.
REWRITE_PROMPT = """You are a query rewriting assistant. Your task is to rewrite medical questions to make them more suitable for retrieval.

Guidelines:
- Keep the core meaning
- Expand medical terms
- Remove ambiguity
- Make it more specific and detailed

Original question: {query}

Rewritten question:"""


def rewrite_prompt(query: Column | str) -> Column:
    """The prompt that asks a model to rewrite a query."""
    head, tail = REWRITE_PROMPT.split("{query}")
    return F.concat(F.lit(head), F.coalesce(_col(query), F.lit("")), F.lit(tail))


def question_preview(text: Column | str, chars: int = 80) -> Column:
    """White space collapsed, cut to `chars` with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars - 3)), F.lit("...")))


def question_key(question: Column | str) -> Column:
    """The cache key of a question: MD5 of its UTF-8 text, in hex."""
    return F.md5(_col(question))


def is_error(response: Column | str) -> Column:
    return F.coalesce(F.startswith(_col(response), F.lit(ERROR_PREFIX)), F.lit(False))


def is_correct(predicted: Column | str, key: Column | str, fold_key: bool = False) -> Column:
    """Whether a prediction equals the key; a null prediction is wrong."""
    right = F.upper(_col(key)) if fold_key else _col(key)
    return F.coalesce(_col(predicted) == right, F.lit(False))
