import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomdex.llm import bpe
from loomdex.llm.queries import op10_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(seed, n):
    rng = random.Random(seed)
    odd = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x660, 0xB2, 0x2167, 0x301, 0x1680, 0xFEFF, 0x10FFFF]]
    kinds = [odd, " \n\t", "abcdehinorst", "'sdlvmret", ["<|endoftext|>", "  ", " the", "ing"]]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_the_library(library):
    tool = bpe.TrieEncoder(bpe.load_spec(PATH))
    texts = random_texts(1, 3000) + ["", " ", "a" * 5000, "ab" * 3000, " " * 2000, "<|endoftext|>" * 3, "a<|endoftext|> b"]
    for text, packed in zip(texts, tool.encode_batch(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert packed == bpe.pack(ids)
        assert tool.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(bpe, "TEXT_CHUNKS", 3)
    tool = bpe.TrieEncoder(bpe.load_spec(PATH))
    texts = random_texts(2, 200)
    for i in range(0, len(texts), 20):
        for text, packed in zip(texts[i : i + 20], tool.encode_batch(texts[i : i + 20]), strict=True):
            assert packed == bpe.pack(library.encode(text, add_special_tokens=False).ids)


def test_documents(spark, odd_documents, no_documents, library):
    found = bpe.digests(odd_documents, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    assert len(found) == 10
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(bpe.pack(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    encoded = bpe.encode_documents(odd_documents.select("doc_id", "text"), PATH, ["doc_id"])
    assert encoded.where("not intact").count() == 0
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(encoded, PATH).collect()}
    assert decoded == texts
    assert bpe.digests(no_documents, PATH).count() == 0


def test_the_registered_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = op10_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(bpe.pack(ids)).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_undone_merges_tell_what_merging_tells():
    """Pairs and single tokens, against plain merging of their bytes; tokens of few letters have ties."""
    tool, rng = bpe.TrieEncoder(bpe.load_spec(PATH)), random.Random(4)
    single = lambda t: [tool.bytes[b] for b in tool.token_bytes[t]]
    few = [t for t in range(50_256) if len(set(tool.token_bytes[t])) <= 2]
    assert tool.orderly
    for t in rng.sample(range(50_256), 2000):
        assert tool.stands_alone(t) == (tool.merge(single(t)) == [t])
    for a, b in [(rng.randrange(50_256), rng.randrange(50_256)) for _ in range(4000)] + [(rng.choice(few), rng.choice(few)) for _ in range(4000)]:
        assert tool.may_follow(a, b) == (tool.merge(single(a) + single(b)) == [a, b])


def test_merges_without_order_are_tried_one_by_one(library, monkeypatch):
    tool = bpe.TrieEncoder(bpe.load_spec(PATH))
    monkeypatch.setattr(tool, "orderly", False)
    texts = random_texts(3, 300)
    for text, packed in zip(texts, tool.encode_batch(texts), strict=True):
        assert packed == bpe.pack(library.encode(text, add_special_tokens=False).ids)


def test_long_texts_and_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 200)
    monkeypatch.setattr(bpe, "PREFIX_IDS", 5)
    tool = bpe.TrieEncoder(bpe.load_spec(PATH))
    texts = ["unbelievably " * 100, "<|endoftext|>" * 40 + "x" * 500, "internationalisation" * 50, "short one"]
    for _ in range(2):
        for text, packed in zip(texts, tool.encode_batch(texts), strict=True):
            assert packed == bpe.pack(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("change", [("normalizer", {"type": "NFC"}), ("model", {"ignore_merges": True}), ("added", {"lstrip": True})])
def test_files_with_other_options_are_refused(change):
    spec = json.loads(bpe.load_spec(PATH))
    kind, value = change
    if kind == "normalizer":
        spec["normalizer"] = value
    elif kind == "model":
        spec["model"] |= value
    else:
        spec["added_tokens"][0] |= value
    with pytest.raises(ValueError):
        bpe.TrieEncoder(json.dumps(spec))
