import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from loomdex.operators import corpus
from loomdex.plans import jobs
from loomdex.sources import archives

FILES = {f"articles/{i:03d}.txt": (f"Article {i}. " + "Some words follow here. " * (i % 7)).encode() for i in range(40)} | {"articles/empty.txt": b"", "readme.md": "é".encode()}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(root / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("articles")
        for name, content in FILES.items():
            z.writestr(name, content)
    for mode, name in (("w", "a.tar"), ("w:gz", "a.tar.gz")):
        with tarfile.open(root / name, mode) as t:
            folder = tarfile.TarInfo("articles")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for member, content in FILES.items():
                info = tarfile.TarInfo(member)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
    return {name: f"{root}/{name}" for name in ("a.zip", "a.tar", "a.tar.gz")}


@pytest.mark.parametrize("name,parallel", [("a.zip", True), ("a.tar", True), ("a.tar.gz", False)])
def test_members_of_archives(spark, paths, name, parallel):
    rows = archives.read_archives(spark, paths[name], partition_bytes=500)
    found = {r["member"]: bytes(r["content"]) for r in rows.collect()}
    assert found == FILES
    assert (rows.rdd.getNumPartitions() > 3) == parallel
    assert rows.where("size <> length(content)").count() == 0
    assert archives.read_archives(spark, paths[name], suffix=".md").count() == 1


def test_several_archives_and_the_job(spark, paths, tmp_path):
    rows = archives.read_articles(spark, paths["a.zip"], paths["a.tar.gz"], suffix=".txt")
    assert rows.count() == 82 and rows.select("source").distinct().count() == 2
    made = {}
    (tmp_path / "a.json").write_text(json.dumps([{"content": c.decode(), "id": n, "source": "a.zip"} for n, c in FILES.items()]))
    for name, given in (("zip", paths["a.zip"]), ("json", str(tmp_path / "a.json"))):
        jobs.main(["chunk-corpus", "--articles", given, "--words", "9", "--overlap", "2", "--out", str(tmp_path / name)], spark)
        made[name] = sorted((r["id"], r["content"]) for r in spark.read.parquet(str(tmp_path / name / "chunks")).collect())
    assert made["zip"] == made["json"] and len(made["zip"]) > 40


def plain_passages(text, most):
    """Passages by the rule, one sentence at a time."""
    out, held = [], ""
    for sentence in (m[0] for m in corpus.SENTENCE.finditer(text)):
        if len((held + sentence).rstrip()) > most and held.strip():
            out.append(held.strip())
            held = ""
        held += sentence
        while len(held.rstrip()) > most:
            at = held.rfind(" ", 1, most + 1)
            at = at if at > 0 else most
            out.append(held[:at].strip())
            held = held[at:].lstrip()
    return out + ([held.strip()] if held.strip() else [])


def test_sections_and_passages(spark):
    page = "<html><head><title>no</title></head><body>intro <b>text</b><h1 id='a'>One</h1><p>First. Second! x</p><script>no</script><h2>Two <i>b</i></h2></body>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "no headings")], "page_id int, html string")
    found = [(r["page_id"], r["section"], r["heading"], r["content"]) for r in corpus.sections(rows, "html").orderBy("page_id", "section").collect()]
    assert found == [(1, 0, "", "intro text"), (1, 1, "One", "First. Second! x"), (1, 2, "Two b", ""), (4, 0, "", "no headings")]
    rng = random.Random(0)
    texts = ["".join(rng.choice(["a", "bb ", "ccc", ". ", "? ", "x" * 30, " "]) for _ in range(200)) for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    for most in (1, 7, 40, 10_000):
        got = corpus.section_passages(pages, "html", most).orderBy("page_id", "part").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("part", "passage"))).alias("p")).collect()
        for r in got:
            text = " ".join(texts[r["page_id"]].split(" "))
            passages = [p["passage"] for p in r["p"]]
            assert passages == plain_passages(corpus_text(text), most)
            assert all(0 < len(p) <= most for p in passages)
            assert "".join(passages).replace(" ", "") == text.replace(" ", "")


def corpus_text(text):
    return " ".join(text.split())
