import hashlib
import random
import time

from loomdex.llm import line_dedup
from tests.llm import brute


def edited(rng, line):
    i = rng.randrange(len(line) + 1)
    kind = rng.randrange(3)
    c = rng.choice("abcé")
    return line[:i] + c + line[i:] if kind == 0 else line[:i] + line[i + 1 :] if kind == 1 else line[:i] + c + line[i + 1 :]


def random_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc déf") for _ in range(rng.choice([12, 13, 20, 31, 32, 33, 65, 300]))) for _ in range(25)]
    base += ["aaaaaaaaaaaaa", "aaaaaaaaaaaaaa", "abababababababab", "  padded line of text  "]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edited(rng, line)
            lines.append(rng.choice([line, line, "", "short"]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_brute_force(documents_of, scratch):
    for seed in range(3):
        rows = random_rows(seed)
        docs = documents_of([(i, t, "en", "s", 0) for i, t in rows])
        want = {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in brute.dedup_lines(rows).items()}
        found = line_dedup.digests(docs, scratch).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text_sha256"]) for r in found} == want
        assert sum(m for _, m, _ in want.values()) > 20


def test_odd_documents(odd_documents, no_documents, scratch):
    found = line_dedup.deduplicated(odd_documents, scratch)
    assert found.columns == odd_documents.columns
    rows = {}
    for r in found.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    # The copy of document 1 lost its only line; null, empty, blank and short texts stay.
    assert set(rows) == {1, 3, 4, 5, 6, 7, 8, None} and len(rows[8]) == 2
    assert rows[5][0]["text"] is None and rows[4][0]["text"] == "" and rows[6][0]["n_chars"] == 5
    assert line_dedup.deduplicated(no_documents, scratch).count() == 0


def test_a_common_line_stays_linear(documents_of, scratch):
    docs = documents_of([(i, f"a line that all the documents share\nand line number {i:04d} of them", "en", "s", 0) for i in range(300)])
    found = {r["doc_id"]: r["n_removed"] for r in line_dedup.digests(docs, scratch).collect()}
    assert found[0] == 0 and all(n >= 1 for i, n in found.items() if i)


def test_great_and_negative_ids(documents_of, scratch):
    line = "one and the same line of text"
    ids = [2**63 - 1, -(2**63), -5, 0, 2**53 + 1]
    docs = documents_of([(i, f"short\n{line}", "en", "s", 0) for i in ids])
    found = {r["doc_id"]: r["n_removed"] for r in line_dedup.digests(docs, scratch).collect()}
    assert found == {i: int(i != min(ids)) for i in ids}


def test_long_lines_take_linear_time(documents_of, scratch):
    """Near-equal lines of 100 kB and of 10 MB, each pair alone in its table."""
    took = {}
    for size in (100_000, 100_000, 10_000_000):
        rng = random.Random(size)
        block = "".join(rng.choice("abcdefgh ij") for _ in range(10_000))
        line = "".join(f"{block}{i}" for i in range(size // 10_000))
        at = size // 3
        docs = documents_of([(1, line, "en", "s", 0), (2, line[:at] + "#" + line[at:], "en", "s", 0), (3, line[:at] + "##" + line[at + 1 :], "en", "s", 0)])
        began = time.time()
        found = {r["doc_id"]: r["n_removed"] for r in line_dedup.digests(docs, scratch).collect()}
        took[size] = time.time() - began
        assert found == {1: 0, 2: 1, 3: 1}  # 3 is one edit from 2 and two from 1
    assert took[10_000_000] < 100 * max(took[100_000], 1)
