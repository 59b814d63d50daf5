import random
import textwrap

import pytest

from loomdex.llm import license_scan
from tests.llm import brute


def files(spark, rows):
    return spark.createDataFrame(rows, "id long, path string, text string")


APACHE = "# code\nLicensed under the Apache License, Version 2.0.\nx = 1"


def test_own_and_nearest_ancestor(spark, scratch):
    rows = [
        (1, "LICENSE", "Released under the MIT License."),
        (2, "src/a.py", "print(1)"),
        (3, "src/lib/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "src/lib/deep/er/b.py", "print(2)"),
        (5, "src/lib/c.py", APACHE),
        (6, "src/library/d.py", None),
        (7, None, "nothing"),
        (8, None, APACHE),
        (9, "other/licensed_text.py", ""),
        (9, "other/licensed_text.py", ""),
    ]
    found = {r["id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan(files(spark, rows), scratch).collect()}
    assert found == {
        1: ("MIT", "own", None),
        2: ("MIT", "inherited", ""),
        3: ("GPL-3.0", "own", None),
        4: ("GPL-3.0", "inherited", "src/lib"),
        5: ("Apache-2.0", "own", None),
        6: ("MIT", "inherited", ""),
        7: (None, None, None),
        8: ("Apache-2.0", "own", None),
        9: ("MIT", "inherited", ""),
    }


def test_every_template_finds_itself(spark, scratch):
    rows = [(i, f"f{i}.txt", f"first line\n{t}\nlast line") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    found = {r["id"]: r for r in license_scan.scan(files(spark, rows), scratch).collect()}
    for i, (name, _) in enumerate(license_scan.TEMPLATES):
        assert found[i]["license"] == name and found[i]["score"] > 0.9


def test_prose_and_nothing(spark, scratch, odd_documents, no_documents):
    rows = [(1, "a.txt", "A driver needs a license to drive and the river bank is quiet at dawn in these parts of the country")]
    assert license_scan.scan(files(spark, rows), scratch).first()["license"] is None
    odd = license_scan.scan(license_scan.document_paths(odd_documents), scratch).collect()
    assert len(odd) == 10 and all(r["license"] is None for r in odd)
    assert license_scan.scan(license_scan.document_paths(no_documents), scratch).count() == 0


PROSE = "\n".join(f"the quiet river bank number {i} lies in the sun at dawn and nobody drives there" for i in range(60))


def test_notice_inside_a_named_document(spark, scratch, documents_of):
    text = PROSE + "\nReleased under the MIT License.\n" + PROSE
    docs = documents_of([(10, text, "en", "a", 0), (11, PROSE, "en", "a", 0), (20, PROSE, "en", "b", 0), (21, PROSE, "en", "b", 0)])
    rows = license_scan.scan(license_scan.document_paths(docs), scratch).collect()
    found = {r["id"]: (r["license"], r["origin"], r["from_dir"]) for r in rows}
    assert found == {10: ("MIT", "own", None), 11: ("MIT", "inherited", "a/0/0"), 20: (None, None, None), 21: (None, None, None)}


def test_full_texts_and_prose_of_licence_files(spark, scratch):
    texts = license_scan.full_texts()
    rows = [(i, f"d{i}/LICENSE", "Copyright (c) 2020 Some Body\n\n" + textwrap.fill(t, 70)) for i, t in enumerate(texts.values())]
    rows += [(100 + i, f"d{i}/a/b.py", "x = 1") for i in range(len(texts))]
    rows += [(200, "p/COPYING", PROSE), (201, "p/q.txt", "text")]
    found = {r["id"]: r["license"] for r in license_scan.scan(files(spark, rows), scratch).collect()}
    for i, name in enumerate(texts):
        assert (found[i], found[100 + i]) == (name, name)
    assert found[200] is None and found[201] is None


def test_wrapped_headers_and_spdx(spark, scratch):
    texts = {n: (license_scan.pkgutil.get_data("loomdex.llm", f"licenses/{n}.txt").decode()) for n in ("MIT", "BSD-3-Clause")}
    wrapped = {n: "\n".join(x for p in t.split("\n\n") for x in [*textwrap.wrap(p, 60), ""]) for n, t in texts.items()}
    rows, want = [], {}
    for name, text in wrapped.items():
        lines = text.split("\n")
        for form in ("\n".join(f"# {x}" for x in lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */", "<!--\n" + text + "\n-->", text):
            want[len(rows)] = name
            rows.append((len(rows), f"f{len(rows)}.txt", f"{form}\nimport os\n\n" + PROSE))
    spdx = {
        "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0+": "GPL-2.0",
        "(MIT OR Apache-2.0)": "Apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0", "NoSuch-1.0": None, "LicenseRef-MIT": None,
    }
    for name, license in spdx.items():
        want[len(rows)] = license
        rows.append((len(rows), f"f{len(rows)}.c", f"/* SPDX-License-Identifier: {name} */\n" + PROSE))
    found = {r["id"]: r["license"] for r in license_scan.scan(files(spark, rows), scratch).collect()}
    assert found == want


def random_files(seed, n=160):
    """Files in directories of several depths: notices whole, wrapped, changed, in comments, beside prose, and identifiers."""
    rng = random.Random(seed)
    words = "river bank quiet sun dawn license copyright software the of and a to in".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    full, rows = list(license_scan.full_texts().values()), []
    for i in range(n):
        parts = [prose() for _ in range(rng.randrange(4))]
        for _ in range(rng.randrange(3)):
            text = rng.choice([t for _, t in license_scan.TEMPLATES] if rng.random() < 0.8 else full[:4])
            if rng.random() < 0.3:
                text = " ".join(w for w in text.split() if rng.random() < 0.8)
            lines = textwrap.wrap(text, 60) if rng.random() < 0.5 else [text]
            parts.append(rng.choice(["\n".join(lines), "\n".join(f"// {x}" for x in lines), "/* " + "\n * ".join(lines) + " */", "  " + text]))
        if rng.random() < 0.1:
            parts.append("# SPDX-License-Identifier: " + rng.choice(["MIT", "GPL-2.0-only OR MIT", "Nothing-1.0", "(Apache-2.0 WITH x)"]))
        rng.shuffle(parts)
        folder = "/".join(rng.choice("ab") for _ in range(rng.randrange(4)))
        name = rng.choice(["LICENSE", "COPYING.md", "x.py", "y.txt", "licensed.txt"]) if rng.random() < 0.5 else f"{i}.c"
        rows.append((i, None if rng.random() < 0.05 else f"{folder}/{name}" if folder else name, None if rng.random() < 0.05 else rng.choice(["\n", "\n\n", "\n--\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, scratch, seed):
    rows = random_files(seed)
    own = license_scan
    want = brute.license_scan(
        rows, own.template_list(), own.THRESHOLD, own.LICENSE_NAME, own.MARKER, own.TOKEN, own.BLANK, own.COMMENTS, own.SPDX, own.SPDX_NAME, own.SPDX_TERM
    )
    found = {r["id"]: (r["license"], r["score"], r["origin"], r["from_dir"]) for r in own.scan(files(spark, rows), scratch).collect()}
    differing = {i for i in want if want[i][0] != found[i][0] or want[i][2:] != found[i][2:] or abs((want[i][1] or 0) - (found[i][1] or 0)) > 2e-6}
    assert not differing, [(want[i], found[i], rows[i]) for i in sorted(differing)[:3]]
    assert sum(origin == "inherited" for _, _, origin, _ in want.values()) > 10


def test_documents_inherit(spark, scratch):
    """In the documents that the registered query scans, some inherit."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = license_scan.scan(license_scan.document_paths(docs), scratch).groupBy("origin").count().collect()
    assert {r["origin"]: r["count"] > 5 for r in rows} == {"own": True, "inherited": True, None: True}
