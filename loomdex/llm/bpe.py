"""Byte-level BPE encoding and decoding by a prefix-sharing trie walk.

Every prefix of a word has one encoding, and the encoding of a longer prefix
ends in the one vocabulary entry t for which the prefix without t ends in a
token that may stand before t.  So a prefix's state is its last token alone.
The distinct words of a batch are walked as a trie, depth first (sorted words
with stacks that are cut back to the common prefix); each shared prefix gets
its state once, and a word's tokens are read backwards from its last state.
The entries that a prefix ends in come from its place in an automaton of the
vocabulary, longest first.  Whether one token may stand before another is
told by undoing the merges next to their border, latest first.

Work and memory are linear in a text's length; a text of LONG_TEXT characters
or more is taken in pieces.

Defined results: a null text is empty and has no tokens; special tokens in a
text are recognised as the tokenizer file says; repeated rows are encoded
alike; an empty table gives no rows; other columns, whatever their names, play
no part.  A file with options that the encoder lacks is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The byte-level pre-tokenisation pattern and the characters
# with the property White_Space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

#: Chunks whose ids are kept during a task, beyond which only those in use are.
CACHE_CHUNKS = 400_000
#: Pairs of tokens kept, whether one may follow the other, and further steps of the automaton.
CACHE_PAIRS, CACHE_STEPS = 250_000, 150_000
#: Length of a prefix, in bytes, up to which its ids are kept for the words that share it.
PREFIX_IDS = 64
#: Characters of a text that is handled piece by piece, and chunks of a piece.
LONG_TEXT, TEXT_CHUNKS = 1_000_000, 100_000

INFINITE = float("inf")
#: Some characters that are neither letters, digits nor white space.
SIGNS = frozenset('.,;:!?-"()')


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def refused(spec: dict) -> str | None:
    """What the encoder cannot do of a tokenizer file."""
    model, kind = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
        return "a byte-level BPE without an added prefix space is needed"
    if spec.get("normalizer"):
        return "normalizers are not supported"
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if given := [k for k in options if model.get(k)]:
        return f"model options {given} are not supported"
    flags = ("single_word", "lstrip", "rstrip")
    if any(t.get(k) for t in spec.get("added_tokens") or () for k in flags):
        return f"added tokens with any of {flags} are not supported"
    return None


class TrieEncoder:
    """Encoder and decoder made from the JSON text of a byte-level BPE file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        if reason := refused(spec):
            raise ValueError(reason)
        to_byte = printable_bytes()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.token_bytes = [b""] * (1 + max(*ids.values(), *self.specials.values()))
        for s, i in ids.items():
            self.token_bytes[i] = s
        self.length = list(map(len, self.token_bytes))
        for s, i in self.specials.items():
            self.token_bytes[i] = s.encode()
        self.packed = [pack([i]) for i in range(len(self.token_bytes))]
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self._read_merges(ids, [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]], as_bytes)
        self._grow_automaton(ids)
        longest_first = sorted(map(re.escape, self.specials), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(longest_first) + ")") if longest_first else None
        self.words = regex.compile(WORD_PATTERN).findall
        chunk = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
        self.chunks, self.chunk_iter = chunk.findall, chunk.finditer
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def _read_merges(self, ids: dict[bytes, int], merges: list, as_bytes) -> None:
        """Ranks by pair (left << 32 | right); and of each token the rank that
        makes it (-1: none) and its two parts.  Merges are orderly if each
        makes a token of its own from tokens that are bytes or made before."""
        size = len(self.token_bytes)
        self.ranks: dict[int, int] = {}
        self.made_by, self.left_part, self.right_part = [-1] * size, [-1] * size, [-1] * size
        self.merged: list[int] = []
        self.orderly = True
        for rank, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            left, right, token = ids[a], ids[b], ids[a + b]
            ready = all(self.length[t] == 1 or self.made_by[t] >= 0 for t in (left, right))
            self.orderly &= ready and self.made_by[token] < 0
            self.ranks[left << 32 | right] = rank
            self.merged.append(token)
            self.made_by[token], self.left_part[token], self.right_part[token] = rank, left, right

    def _grow_automaton(self, ids: dict[bytes, int]) -> None:
        """The trie of all tokens.  A node's fallback (the node of its longest
        proper suffix) and the nearest token at or below it are found when they
        are first asked for."""
        self.steps: dict[int, int] = {}  # node << 8 | byte -> node
        self.parent, self.byte, self.depth, self.token_at = array("i", [0]), bytearray(1), [0], [-1]
        for s, i in ids.items():
            at = 0
            for b in s:
                to = self.steps.get(at << 8 | b)
                if to is None:
                    to = self.steps[at << 8 | b] = len(self.depth)
                    self.parent.append(at)
                    self.byte.append(b)
                    self.depth.append(self.depth[at] + 1)
                    self.token_at.append(-1)
                at = to
            self.token_at[at] = i
        self.spare_steps = CACHE_STEPS
        self.fallbacks = array("i", [-1]) * len(self.depth)
        self.first_end, self.next_end = [-1] * len(self.depth), [-1] * len(self.depth)

    def fallback(self, node: int) -> int:
        found = self.fallbacks[node]
        if found < 0:
            up = self.parent[node]
            found = self.fallbacks[node] = self.step(self.fallback(up), self.byte[node]) if up else 0
        return found

    def step(self, node: int, byte: int) -> int:
        """The node of the longest suffix of node and byte; every byte is a token, so there is one."""
        at = node
        while (to := self.steps.get(at << 8 | byte)) is None:
            at = self.fallback(at)
        if at != node and self.spare_steps:
            self.spare_steps -= 1
            self.steps[node << 8 | byte] = to
        return to

    def end_at(self, node: int) -> int:
        """The nearest node, this one or down its fallbacks, of a token that stands alone."""
        if self.first_end[node] < 0:
            if (token := self.token_at[node]) >= 0 and self.stands_alone(token):
                self.first_end[node] = node
            else:
                below = self.fallback(node)
                self.first_end[node] = self.end_at(below) if below else 0
        return self.first_end[node]

    def end_below(self, node: int) -> int:
        found = self.next_end[node] = self.end_at(self.fallback(node))
        return found

    def merge(self, parts: list[int]) -> list[int]:
        """Plain merging."""
        while len(parts) > 1:
            best = min(
                ((rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] << 32 | parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [self.merged[best[0]]]
        return parts

    def meet(self, left: int, right: int, left_until: float, right_until: float) -> bool:
        """Whether, when the bytes of two tokens that stand alone are merged, a
        merge runs across their border before the ranks at which the one and
        the other become part of something longer.  Undoing the later of the
        two tokens' merges again and again gives all pairs that ever stand at
        the border.  Of equal merges the left one comes first."""
        made_by, ranks = self.made_by, self.ranks
        while True:
            rank = ranks.get(left << 32 | right)
            if rank is not None and rank < left_until and rank <= right_until:
                return True
            a, b = made_by[left], made_by[right]
            if a > b:
                left_until, left = a, self.right_part[left]
            elif b >= 0:
                right_until, right = b, self.left_part[right]
            else:
                return False

    def stands_alone(self, token: int) -> bool:
        """Whether the token's bytes alone are encoded as it."""
        known = self.whole.get(token)
        if known is None:
            if self.length[token] == 1:
                known = True
            elif not self.orderly:
                known = self.merge([self.bytes[b] for b in self.token_bytes[token]]) == [token]
            elif (rank := self.made_by[token]) < 0:
                known = False
            else:
                left, right = self.left_part[token], self.right_part[token]
                known = self.stands_alone(left) and self.stands_alone(right) and not self.meet(left, right, rank, rank)
            self.whole[token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens that stand alone are encoded as these two."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        if self.orderly:
            known = not self.meet(left, right, INFINITE, INFINITE)
        else:
            both = self.token_bytes[left] + self.token_bytes[right]
            known = self.merge([self.bytes[b] for b in both]) == [left, right]
        self.pairs[left << 32 | right] = known
        return known

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each distinct word, as little-endian unsigned 32-bit.

        For each prefix of the word at hand, `places` has its node in the
        automaton, `last` its last token (the one among the tokens it ends in
        that may follow the last token of what is before it), and `done`, as
        far as PREFIX_IDS, its ids."""
        steps, pairs, depth_of, token_at, packed = self.steps, self.pairs, self.depth, self.token_at, self.packed
        first_end, next_end, length = self.first_end, self.next_end, self.length
        out, before, places, last, done = {}, b"", [0], [-1], [b""]
        for text in sorted(words):
            word = text.encode()
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del places[shared + 1 :], last[shared + 1 :], done[shared + 1 :]
            at = places[shared]
            for size, byte in enumerate(word[shared:], shared + 1):
                to = steps.get(at << 8 | byte)
                at = self.step(at, byte) if to is None else to
                places.append(at)
                end = first_end[at]
                if end < 0:
                    end = self.end_at(at)
                while start := size - depth_of[end]:
                    token = token_at[end]
                    fits = pairs.get(last[start] << 32 | token)
                    if fits or fits is None and self.may_follow(last[start], token):
                        break
                    below = next_end[end]
                    end = self.end_below(end) if below < 0 else below
                token = token_at[end]
                last.append(token)
                if size <= PREFIX_IDS:
                    done.append(done[start] + packed[token])
            rest, size = [], len(word)
            while size > PREFIX_IDS:
                rest.append(packed[last[size]])
                size -= length[last[size]]
            out[text] = done[size] + b"".join(reversed(rest)) if rest else done[size]
            before = word
        return out

    def words_of(self, chunk: str) -> list[str] | None:
        """The words of a chunk, None if it is one word.  Most are letters
        alone or with one sign, and need no pattern."""
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():
            return None
        if body[-1:] in SIGNS and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Adds chunks and their words to the cache, all new words in one walk."""
        missing = chunks.difference(self.cache)
        if not missing:
            return
        if len(self.cache) + len(missing) > CACHE_CHUNKS:
            self.cache = {c: self.cache[c] for c in chunks - missing}
        cache, words, split = self.cache, set(), {}
        for c in missing:
            parts = self.words_of(c)
            if parts is None:
                words.add(c)
            else:
                split[c] = parts
                words.update(parts)
        cache |= self.encode_words(words.difference(cache))
        for c, parts in split.items():
            if len(parts) > 1:
                cache[c] = b"".join([cache[w] for w in parts])

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of chunks that are encoded independently, and special ids."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.specials) else [text]
        for part in parts:
            if part in self.specials:
                yield self.specials[part]
            elif len(part) < TEXT_CHUNKS:
                yield self.chunks(part)
            else:
                some = []
                for m in self.chunk_iter(part):
                    some.append(m[0])
                    if len(some) == TEXT_CHUNKS:
                        yield some
                        some = []
                yield some

    def joined(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids of one text, learned piece by piece."""
        out = bytearray()
        for piece in self.pieces(text):
            if isinstance(piece, int):
                out += pack([piece])
            else:
                self.learn(set(piece))
                out += self.joined(piece)
        return bytes(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.  What short texts hold is learned at once."""
        pieces = [list(self.pieces(t)) if len(t) < LONG_TEXT else None for t in texts]
        self.learn({c for ps in pieces if ps for p in ps if not isinstance(p, int) for c in p})
        short = [
            None if ps is None else b"".join([pack([p]) if isinstance(p, int) else self.joined(p) for p in ps]) for ps in pieces
        ]
        return [self.encode(t) if packed is None else packed for t, packed in zip(texts, short)]

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def pack(tokens: list[int]) -> bytes:
    return array("I", tokens).tobytes()


@lru_cache(maxsize=1)
def encoder(spec: str) -> TrieEncoder:
    """The encoder of a worker's task.  It is made anew for each task and given
    up after it: that takes half a second, and a worker that waits for other
    work does not hold a hundred megabytes."""
    return TrieEncoder(spec)


def load_spec(path: str) -> str:
    """The tokenizer file's text, read on the driver; it goes to the tasks with
    the function, so executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, n_tokens, the token ids, and whether they decode to the text."""
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))

    def make():
        tool = encoder(spec.value)

        def run(texts: list[str]):
            for t, packed in zip(texts, tool.encode_batch(texts)):
                yield len(packed) // 4, np.frombuffer(packed, np.int32), tool.decode(packed) == t

        run.done = encoder.cache_clear
        return run

    schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("intact", pa.bool_())])
    return map_rows(docs, make, schema, "n_tokens long, ids array<int>, intact boolean", keep, text)


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))

    @F.pandas_udf("string")
    def decoded(column):
        tool = encoder(spec.value)
        return column.map(lambda v: "" if v is None else tool.decode(pack([int(i) for i in v])))

    return encoded.withColumn(text, decoded(F.col(ids)))


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))

    def make():
        tool = encoder(spec.value)

        def run(texts: list[str]):
            for packed in tool.encode_batch(texts):
                yield (
                    len(packed) // 4,
                    hashlib.sha256(packed).hexdigest(),
                    hashlib.sha256(tool.decode(packed).encode()).hexdigest(),
                )

        run.done = encoder.cache_clear
        return run

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, make, schema, ddl, ["doc_id"])
