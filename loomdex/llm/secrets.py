"""Secret scan: an Aho-Corasick keyword prefilter, anchored patterns at the
hits only, then checks of embedded checksums.

Texts are handled as UTF-8 bytes, so that lower-casing A-Z keeps every
position; spans are reported in code points, end exclusive.  A run of 24 hex
digits has no keyword of its own: bytes are first mapped to a class string,
whose "keyword" is 24 class letters in a row.

Work is linear in a text's length, whatever it holds.

Defined results: a null or empty text has no secrets; repeated rows give
repeated results; an empty table gives no rows; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

#: Kinds in the order in which ties on a start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

# Keywords, anchored patterns and least lengths of the base kinds.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}
# Tokens whose last six base-62 digits are the CRC-32 of the thirty before.
SUMMED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
JWT_PART = re.compile(rb"[A-Za-z0-9_-]*")
PEM = re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")

HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
HEX_RUN = b"h" * HEX_LEAST
BASE62 = (string.digits + string.ascii_uppercase + string.ascii_lowercase).encode()


def base62_crc(payload: bytes) -> bytes:
    value, digits = zlib.crc32(payload), b""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d : d + 1] + digits
    return digits


def valid_jwt(m: re.Match[bytes]) -> bool:
    """The first part must decode to a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def anchored(kind: str, data: bytes, start: int) -> tuple[re.Match[bytes] | None, bool]:
    """The match at this very place, and whether it is a secret."""
    if kind == "assign":
        m = ASSIGN.match(data, start)
        return m, m is not None and len(m[2]) >= ASSIGN_LEAST
    if kind == "access":
        m = ACCESS.match(data, start)
        return m, m is not None and len(m[0]) >= ACCESS_LEAST
    if kind in ("github", "npm"):
        m = SUMMED.match(data, start)
        return m, m is not None and base62_crc(m[1]) == m[2]
    if kind == "jwt":
        m = JWT.match(data, start)
        return m, m is not None and valid_jwt(m)
    m = PEM.match(data, start)
    return m, m is not None


def byte_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes: leftmost and non-overlapping within a kind."""
    hits: dict[str, list[int]] = {}
    for end, (size, kind) in automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end - size + 1)
    out = []
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start >= free:
                m, secret = anchored(kind, data, start)
                if m:
                    free = m.end()
                    if secret:
                        out.append((start, m.end(), kind))
                elif kind == "jwt":  # the first part runs to the end of these characters, so no other start in them can do better
                    free = JWT_PART.match(data, start).end()
    classes = data.translate(HEX_CLASS)
    at = classes.find(HEX_RUN)
    while at >= 0:
        end = HEX.match(data, at).end()
        out.append((at, end, "hex"))
        at = classes.find(HEX_RUN, end)
    return out


def text_spans(text: str) -> list[tuple[int, int, str]]:
    """The same in code points, by start and then kind as listed."""
    data = text.encode()
    found = byte_spans(data)
    if found and len(data) != len(text):
        places = sorted({p for start, end, _ in found for p in (start, end)})
        chars, at, before = {}, 0, 0
        for p in places:
            at += len(data[before:p].decode())
            chars[p], before = at, p
        found = [(chars[s], chars[e], k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and the array column `secrets` of structs (kind, start, stop)."""

    def make():
        return lambda texts: ([[{"kind": k, "start": s, "stop": e} for s, e, k in text_spans(t)]] for t in texts)

    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    return map_rows(
        docs, make, pa.schema([("secrets", pa.list_(item))]),
        "secrets array<struct<kind: string, start: long, stop: long>>", keep, text,
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every text."""

    def make():
        def run(texts: list[str]):
            for t in texts:
                found = text_spans(t)
                base = [x for x in found if x[2] in BASE_KINDS]
                listed = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
                yield (
                    *(sum(x[2] == k for x in base) for k in BASE_KINDS),
                    hashlib.sha256(listed(base).encode()).hexdigest(),
                    listed(found),
                )

        return run

    schema = pa.schema(
        [(f"n_{k}", pa.int64()) for k in BASE_KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())]
    )
    ddl = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_rows(docs, make, schema, ddl, ["doc_id"])
