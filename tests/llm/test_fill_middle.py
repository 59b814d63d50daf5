import hashlib
import random
import re

from pyspark.sql import functions as F

from loomdex.llm import fill_middle
from loomdex.llm.fill_middle import ESCAPE, MARK, Settings

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_python(doc_id, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) by lists of units."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_rows(seed, n=400):
    rng = random.Random(seed)
    pieces = ["a", "bé", "𝒳y", " ", "  ", "\t\n", "\x0b", "\x0c\r", "\x1c", " ", "　", MARK, ESCAPE, ESCAPE + "m", ESCAPE + "e", MARK + "e",
              "<", ">", "<P", "P>", "S>", "$1", "\\", "\x00", "<P>"]
    weights = [8] * 11 + [4] * 9 + [1] * 4 + [0.1]
    return [(i, "".join(rng.choices(pieces, weights, k=rng.choice([0, 1, 2, 3, 10, 40])))) for i in range(n)]


def test_equals_plain_python_and_comes_back(documents_of):
    rows = random_rows(1) + [(i + 1000, "one two  three\n") for i in range(60)]
    found = fill_middle.transformed(documents_of([(i, t, "en", "s", 0) for i, t in rows]))
    found = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        i = r["row"]["doc_id"]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_python(i, texts[i])
        assert r["back"] == texts[i]
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    # Empty prefixes, middles and suffixes are among them.
    cut = [r for r in found if r["form"] == "spm"]
    assert any(r["prefix_chars"] == 0 for r in cut) and any(r["middle_chars"] == 0 for r in cut) and any(r["output"].startswith("<S><P>") for r in cut)


def test_odd_documents(odd_documents, no_documents):
    found = fill_middle.digests(odd_documents).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    assert len(found) == odd_documents.count()
    for r in found:
        n, form, p, m, output = plain_python(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert fill_middle.digests(no_documents).count() == 0


def test_settings(documents_of):
    docs = documents_of([(i, f"word {i} and <P> more", "en", "s", 0) for i in range(200)])
    every = Settings(seed=7, percent=100, suffix_first_percent=0, prefix="«p»", suffix="«s»", middle="«m»")
    found = fill_middle.transformed(docs, every)
    found = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), every)).collect()
    assert all(r["form"] == "psm" and r["output"].startswith("«p»") and r["back"] == f"word {r['row']['doc_id']} and <P> more" for r in found)
    assert fill_middle.transformed(docs, Settings(percent=0)).where("form <> 'plain'").count() == 0


def test_no_exchange(documents_of):
    plan = fill_middle.digests(documents_of([(1, "a", "en", "s", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
