import random
import re
import zlib
from collections import Counter

import pytest

from loomdex.llm import spelling
from loomdex.llm.spelling import Settings
from tests.llm import brute

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_python(rows, settings=Settings()):
    """{word: (form, root, n, n_near, form_n)} by comparing all words by their edits."""
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            if settings.damage_every:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % settings.damage_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= settings.min_chars and n >= settings.min_count}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        if len(w) > 100:
            near[w] = {x for x in words if x != w and brute.within_one(w, x)}
            continue
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (edits - {w}) & words.keys()
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= settings.ratio * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, len(near[w]), words.get(forms[w])) for w, n in words.items()}


def found_by(docs, scratch, settings=Settings()):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs, scratch, settings).collect()}


def random_rows(seed, letters, lengths, n_base=30):
    """Words with their variants, whose counts fall by steps."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n_base)]
    bag = []
    for word in words:
        times = rng.choice([3, 5, 30, 160, 900])
        while times:
            bag += [word] * times
            i, c = rng.randrange(len(word)), rng.choice(letters)
            word = rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word + c, c + word])
            times //= rng.choice([2, 5, 6])
    rng.shuffle(bag)
    return [(i, " ".join(bag[i::50])) for i in range(50)]


def test_equals_plain_python(documents_of, scratch):
    for seed, letters, lengths in ((0, "abcdéÀÿ", [5, 6, 7, 8]), (1, "ab", [6, 7, 8, 9, 13]), (2, "aBcß÷", [6, 20, 41])):
        rows = random_rows(seed, letters, lengths)
        want = plain_python(rows)
        assert found_by(documents_of([(i, t, "en", "s", 0) for i, t in rows]), scratch) == want
        assert any(form for form, *_ in want.values()) and any(root != form and form for form, root, *_ in want.values())


def test_large_blocks_are_subdivided(documents_of, scratch, monkeypatch):
    """With one prefix and one suffix for thousands of words, and any bound of a block."""
    rng = random.Random(3)
    words = {"inter" + "".join(rng.choice("abc") for _ in range(rng.choice([3, 4]))) + "ation" for _ in range(4000)}
    rows = [(i, " ".join(sorted(words))) for i in range(5)]
    want = plain_python(rows)
    docs = documents_of([(i, t, "en", "s", 0) for i, t in rows])
    for bound in (1, 40, 10**9):
        monkeypatch.setattr(spelling, "BLOCK_PAIRS", bound)
        assert found_by(docs, scratch) == want
    assert max(near for *_, near, _ in want.values()) > 10


def test_damage_and_settings(documents_of, scratch):
    rows = [(i, f"consider consider Considér CONSIDER abc_wonderful{'x' * (i % 3)}") for i in range(40)] + [(None, "consider" * 20)] * 6
    docs = documents_of([(i, t, "en", "s", 0) for i, t in rows])
    for settings in (Settings(), Settings(damage_every=3), Settings(damage_every=1), Settings(min_chars=1, min_count=1, ratio=2), Settings(damage_every=None, ratio=2)):
        assert found_by(docs, scratch, settings) == plain_python(rows, settings)


def test_odd_documents(odd_documents, no_documents, documents_of, scratch):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert found_by(odd_documents, scratch, Settings(min_count=1)) == plain_python(rows, Settings(min_count=1))
    assert found_by(no_documents, scratch) == {}
    assert found_by(documents_of([(1, None, None, None, None), (2, "", "", "", 0)]), scratch) == {}
    # A very long word, and one that is an edit away from it.
    long = "abcdefghij" * 3000
    rows = [(i, f"{long} {long} {long[:777]}{long[778:]}") for i in range(6)]
    short = long[:777] + long[778:]
    found = found_by(documents_of([(i, t, "en", "s", 0) for i, t in rows]), scratch, Settings(ratio=2, damage_every=None))
    assert found == {long: (None, long, 12, 1, None), short: (long, long, 6, 1, 12)}
    with pytest.raises(ValueError):
        Settings(ratio=1)
