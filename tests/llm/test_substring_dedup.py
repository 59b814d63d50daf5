import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import substring_dedup
from loomdex.llm.substring_dedup import COVERS, Anchors
from tests.llm.brute import WORD


def plain_python(rows, window):
    """[(doc_id, n_words, n_removed, kept)] by counting all windows."""
    texts = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def key(rows):
    return sorted((repr(i), n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, n, m, kept in rows)


def found_by(docs, window, scratch):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digests(docs, window, scratch).collect())


def random_rows(seed, window):
    """Texts that share passages around the window's length, at all alignments, copies and texts that repeat themselves."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "aB", "é", "x" * 300, "x" * 299 + "y"]) + str(rng.randrange(10**6))
    passages = [[word() for _ in range(window + rng.choice([-2, -1, 0, 1, 7, 60]))] for _ in range(14)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randrange(5)):
            words += [word() for _ in range(rng.randrange(40))]
            words += rng.choice(passages)
        if rng.random() < 0.2:
            words += ["again"] * rng.randrange(window - 2, 2 * window) + ["a", "b", "c"] * rng.randrange(window)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(i + 200, rows[i][1]) for i in range(0, 30, 3)] + [(i + 300, rows[i][1] + " one more") for i in range(0, 30, 5)]
    return rows


@pytest.mark.parametrize("seed,window", [(0, 35), (1, 35), (2, 13), (3, 3), (4, 60)])
def test_equals_plain_python(documents_of, scratch, seed, window):
    rows = random_rows(seed, window)
    want = plain_python(rows, window)
    assert found_by(documents_of([(i, t, "en", "s", 0) for i, t in rows]), window, scratch) == key(want)
    assert sum(0 < m < n for _, n, m, _ in want) > 10


@pytest.mark.parametrize("period,cover", COVERS.items())
def test_covers(period, cover):
    """Any two places are brought to places of the cover by one shift."""
    for a, b in product(range(period), repeat=2):
        assert any((a + d) % period in cover and (b + d) % period in cover for d in range(period))


def test_anchors():
    assert (Anchors(35).period, Anchors(35).words) == (21, 15)
    assert all(Anchors(n).words >= min(n, substring_dedup.LEAST_ANCHOR) for n in range(1, 200))


def test_long_words_have_no_structure():
    """A sum over powers is the same for two words of this kind; their hashes are not."""
    a = "a"
    for _ in range(13):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    data, starts = substring_dedup.texts_bytes(pa.array([a, b, None, "", a]))
    for table in substring_dedup.TABLES:
        words, bounds = substring_dedup.word_hashes(data, starts, table)
        assert words[0] != words[1] and words[0] == words[2] and list(np.diff(bounds)) == [1, 1, 0, 0, 1]


def test_odd_documents(odd_documents, no_documents, documents_of, scratch):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert found_by(odd_documents, 5, scratch) == key(plain_python(rows, 5))
    assert found_by(no_documents, 35, scratch) == []
    assert substring_dedup.deduplicated(no_documents, 35, scratch).columns == no_documents.columns
    # Repeated rows, with an id and without one, are copies.
    text = " ".join(map(str, range(50)))
    rows = [(1, text), (1, text), (None, text + " x"), (None, text + " y"), (None, "b" + text * 2), (None, "b" + text * 2)]
    assert found_by(documents_of([(i, t, None, None, None) for i, t in rows]), 35, scratch) == key(plain_python(rows, 35))


def test_a_passage_of_all_documents(documents_of, scratch):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(300)] + [(i + 1000, passage) for i in range(300)]
    assert found_by(documents_of([(i, t, "en", "s", 0) for i, t in rows]), 35, scratch) == key(plain_python(rows, 35))


def test_deduplicated_keeps_columns(documents_of, scratch):
    rows = random_rows(5, 35)[:40]
    want = {i: (m, kept) for i, _, m, kept in plain_python(rows, 35)}
    texts = dict(rows)
    docs = documents_of([(i, t, "en", "s", 7) for i, t in rows], clashing=True)
    found = substring_dedup.deduplicated(docs, 35, scratch)
    assert found.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    assert got == {i: kept if m else texts[i] for i, (m, kept) in want.items()}
