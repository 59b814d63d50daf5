"""Model adapters: embedding, reranking, query rewriting and generation.

A model is a plain object with one method on a list; adapters call it for
Arrow batches, making it once a task.  It is named by what `register` knows, by
"package.module:attribute", or by the callable that makes it; tasks get that
callable, so a model registered on the driver works in them.  The `Hashed…`
and `Overlap…` models are deterministic stand-ins that need no network and no
weights.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import logging
import random
import re
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import partial
from importlib.util import find_spec
from threading import BoundedSemaphore, Lock
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rates import Places
from .text import ERROR_PREFIX, rewrite_prompt

WORDS = re.compile(r"\w+")


LOG = logging.getLogger(__name__)

class EmbeddingModel(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class PairModel(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class TextModel(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class HashedWords(dict):
    """The place of each word, and after all places those of words that count as -1.  It is
    filled as words are asked, and bounded."""

    MOST = 200_000

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        self[word] = place = h % self.dimension + (0 if h >> 63 else self.dimension)
        return place


class HashedEmbedding:
    """A unit vector of hashed word counts."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.places = HashedWords(dimension)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out, place = np.zeros((len(texts), self.dimension)), self.places.__getitem__
        for row, text in zip(out, texts):
            counts = np.bincount(np.array(list(map(place, WORDS.findall(text.lower()))), np.int64), minlength=2 * self.dimension)
            row += counts[: self.dimension] - counts[self.dimension :]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()


class OverlapPairs:
    """The share of a query's words that a passage holds."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        out, text, held = [], None, set()
        for q, t in pairs:
            if t != text:  # pairs of one passage follow each other where hits were joined to it
                text, held = t, set(WORDS.findall(t.lower()))
            own = set(WORDS.findall(q.lower()))
            out.append(len(own & held) / len(own) if own else 0.0)
        return out


class HashedAnswers:
    """An option letter that depends on the prompt alone."""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [f"Answer: {'ABCDE'[hashlib.md5(p.encode()).digest()[0] % 5]}" for p in prompts]


class EchoRewrite:
    """The query with white space collapsed.  It takes the query itself, not a prompt around it."""

    takes_query = True

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [" ".join(p.split()) for p in prompts]


class ChatModel:
    """A chat endpoint: the first choice's content, else its reasoning, else an empty text."""

    def __init__(self, base_url: str, options: Mapping[str, object], api_key: str = "", timeout: float = 120.0):
        self.url = base_url.rstrip("/") + "/chat/completions"
        self.options, self.timeout = dict(options), timeout
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})

    def one(self, prompt: str) -> str:
        body = json.dumps(self.options | {"messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(self.url, body, self.headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            message = json.load(reply)["choices"][0]["message"]
        return message.get("content") or message.get("reasoning_content") or ""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [self.one(p) for p in prompts]


def available_devices() -> list[str]:
    """What models can run on here; only cpu without the library that tells."""
    try:
        import torch
    except ImportError:
        return ["cpu"]
    mps = getattr(torch.backends, "mps", None)
    return ["cuda"] * torch.cuda.is_available() + ["mps"] * bool(mps and mps.is_available()) + ["cpu"]


DEVICES = ("cuda", "mps", "cpu")


def resolve_device(wanted: str | None, available: Sequence[str]) -> str:
    """auto, or nothing, takes the best available device; one that is not there becomes cpu."""
    word = (wanted or "auto").strip().lower()
    if word == "auto":
        return next((d for d in DEVICES if d in available), "cpu")
    if word.split(":")[0] not in DEVICES:
        raise ValueError(f"unknown device {wanted!r}")
    return word if word.split(":")[0] in available else "cpu"


def device_for(wanted: str | None) -> str:
    return resolve_device(wanted, available_devices())


# Short names of embedding models.
EMBEDDING_ALIASES = {
    "default": "sentence-transformers/all-MiniLM-L6-v2",
    "medical": "emilyalsentzer/Bio_ClinicalBERT",
    "pubmed": "sentence-transformers/all-mpnet-base-v2",
    "biobert": "dmis-lab/biobert-base-cased-v1.1",
    "bge-m3": "BAAI/bge-m3",
    "bge-small": "BAAI/bge-small-en-v1.5",
}
RERANKER = "BAAI/bge-reranker-large"


class SentenceEmbedding:
    """Unit vectors of a sentence-transformers model, by its name or a short one."""

    library = "sentence_transformers"

    def __init__(self, model: str = "default", device: str = "auto", batch_size: int = 256):
        from sentence_transformers import SentenceTransformer

        self.batch_size = batch_size
        self.model = SentenceTransformer(EMBEDDING_ALIASES.get(model, model), device=device_for(device))
        self.dimension = self.model.get_sentence_embedding_dimension()

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.model.encode(list(texts), batch_size=self.batch_size, normalize_embeddings=True).tolist()


class CrossEncoderPairs:
    """Scores of a sentence-transformers cross-encoder."""

    library = "sentence_transformers"

    def __init__(self, model: str = RERANKER, device: str = "auto"):
        from sentence_transformers import CrossEncoder

        self.model = CrossEncoder(model, device=device_for(device))

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        return [float(x) for x in self.model.predict([list(p) for p in pairs])]


Maker = Callable[[], object]
REGISTRY: dict[str, Callable[..., object]] = {
    "hashed-embedding": HashedEmbedding,
    "overlap-pairs": OverlapPairs,
    "hashed-answers": HashedAnswers,
    "echo-rewrite": EchoRewrite,
    "chat": ChatModel,
    "sentence-embedding": SentenceEmbedding,
    "cross-encoder": CrossEncoderPairs,
}


def register(name: str, make: Callable[..., object]) -> None:
    """Makes a model known by a name."""
    REGISTRY[name] = make


def maker(model: str | Maker, /, **settings) -> Maker:
    """What makes the model: of a registered name, of "package.module:attribute",
    or the callable itself; with settings, if any are given."""
    if callable(model):
        make = model
    elif model in REGISTRY:
        make = REGISTRY[model]
    elif ":" in model:
        module, _, attribute = model.partition(":")
        make = getattr(importlib.import_module(module), attribute)
    elif model in EMBEDDING_ALIASES:
        make = partial(SentenceEmbedding, model)
    else:
        raise ValueError(f"unknown model {model!r}; known: {sorted(REGISTRY)}")
    return partial(make, **settings) if settings else make


def create(name: str | Maker):
    return maker(name)()


def pair_stats(model: str | Maker | None, top_k: int, device: str = "auto") -> dict[str, object]:
    """What a reranking run uses, and whether its model can be made here: a
    model of a library can where that is installed; it is not loaded for this."""
    make = maker(model) if model is not None else None
    needs = getattr(getattr(make, "func", make), "library", None)
    available = make is not None and (needs is None or find_spec(needs) is not None)
    name = model if model is None or isinstance(model, str) else getattr(model, "__name__", type(model).__name__)
    return {"reranking": model is not None, "available": available, "model": name, "device": device_for(device), "top_k": top_k}


class TokenBucket:
    """At most `rate` calls a second on average, and `burst` at once."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at, self.lock = float(burst), clock(), Lock()

    def acquire(self) -> None:
        with self.lock:
            while True:
                now = self.clock()
                self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
                self.at = now
                if self.tokens >= 1:
                    self.tokens -= 1
                    return
                self.sleep((1 - self.tokens) / self.rate)


def rate_for(requests_per_minute: float, partitions: int, headroom: float = 0.9) -> float:
    """Each partition's share of a global rate, with some headroom."""
    return headroom * requests_per_minute / 60 / max(1, partitions)


def with_retries(call: Callable[[], str], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; failures are repeated after 1, 2, 4, … seconds."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(2.0**i + random.random() * 0.1)
    raise ValueError("attempts must be positive")


def once(function):
    """The function marked as not deterministic: else a filter on what is made
    of its result is pushed below it with a second call of the model."""
    return function.asNondeterministic()


def embed_column(text: Column | str, model: str | Maker = "hashed-embedding") -> Column:
    make = maker(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for batch in batches:
            yield pd.Series(own.embed(batch.fillna("").tolist()), index=batch.index)

    return once(run)(text)


def score_pairs(query: Column | str, text: Column | str, model: str | Maker = "overlap-pairs") -> Column:
    """The model's scores; null where it cannot be made or fails, so that the old
    order holds.  The failure goes to the task's log."""
    make = maker(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            own = make()
        except Exception:  # noqa: BLE001
            LOG.exception("the reranking model cannot be made")
            own = None
        for q, t in batches:
            found = [None] * len(q)
            try:
                if own is not None:
                    found = own.score(list(zip(q.fillna(""), t.fillna(""))))
            except Exception:  # noqa: BLE001
                LOG.exception("the reranking model failed on %d pairs", len(q))
            yield pd.Series(found, index=q.index, dtype="float64")

    return once(run)(query, text)


def rolling(batches: Iterable[pd.Series], call: Callable[[str], str], in_flight: int, ahead: int = 2) -> Iterator[pd.Series]:
    """The calls' results, batch by batch in order, with `in_flight` calls under
    way and `ahead` times as many handed over: a slow call holds up its own
    batch, not those that follow."""
    slots = BoundedSemaphore(in_flight * ahead)
    waiting: deque[tuple[pd.Index, list[Future]]] = deque()

    def handed_over(pool: ThreadPoolExecutor, text: str) -> Future:
        slots.acquire()
        future = pool.submit(call, text)
        future.add_done_callback(lambda _: slots.release())
        return future

    def collected(index: pd.Index, futures: list[Future]) -> pd.Series:
        return pd.Series([f.result() for f in futures], index=index, dtype=object)

    with ThreadPoolExecutor(in_flight) as pool:
        for batch in batches:
            waiting.append((batch.index, [handed_over(pool, text) for text in batch]))
            while waiting and all(f.done() for f in waiting[0][1]):
                yield collected(*waiting.popleft())
        while waiting:
            yield collected(*waiting.popleft())


def complete_column(
    prompt: Column | str,
    model: str | Maker,
    requests_per_minute: float | None = None,
    partitions: int = 1,
    in_flight: int = 4,
    attempts: int = 5,
    places: Places | None = None,
) -> Column:
    """The model's text for each prompt.  Calls take their places in the run's
    schedule, if it has one; else a rate is that of all partitions together, of
    which each has a share.  A call that keeps failing gives the error text
    instead, so one failure does not end the job."""
    make = maker(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        bucket = places
        if bucket is None and requests_per_minute:
            bucket = TokenBucket(rate_for(requests_per_minute, partitions), in_flight)

        def attempt(p: str) -> str:
            if bucket:
                bucket.acquire()
            return own.complete([p])[0]

        def one(p: str) -> str:
            try:
                return with_retries(lambda: attempt(p), attempts)
            except Exception as e:  # noqa: BLE001
                return f"{ERROR_PREFIX} {e}"

        yield from rolling((b.fillna("") for b in batches), one, in_flight)

    return once(run)(prompt)


def rewrite_queries(queries: DataFrame, query: str, gate: Column, model: str | Maker = "echo-rewrite", **calls) -> DataFrame:
    """Adds rewritten: the model's text where the gate is true, the query
    itself elsewhere and where the model gives nothing or fails.  The rows are
    split by the gate, because a condition around a Python function would not
    spare the calls."""
    make = maker(model)
    takes_query = getattr(getattr(make, "func", make), "takes_query", False)
    gated = queries.withColumn("_gate", F.coalesce(gate, F.lit(False)))
    said = complete_column(F.col(query) if takes_query else rewrite_prompt(query), make, **calls)
    useful = F.when(~F.startswith("_said", F.lit(ERROR_PREFIX)), F.nullif(F.trim("_said"), F.lit("")))
    asked = gated.where("_gate").withColumn("_said", said).withColumn("rewritten", F.coalesce(useful, F.col(query)))
    rest = gated.where("not _gate").withColumn("rewritten", F.col(query))
    return asked.drop("_said", "_gate").unionByName(rest.drop("_gate"))
