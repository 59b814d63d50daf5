"""The k best documents of each query, kept while a task reads its rows."""

from __future__ import annotations

import numpy as np

#: Digits of a score that count when documents are ranked.
DIGITS = 6
SCALE = 10.0**DIGITS
#: Candidates that are held beside twice the best ones before they are cut.
SPARE = 500_000


def tasks_of(cores: int, groups: int) -> int:
    """Tasks that rows are dealt to for each group of queries: each passes on its own best, so
    they are as few as keep all cores at work, but several for a core where groups are."""
    return cores if groups == 1 else max(1, min(cores, -(-4 * cores // groups)))


def sorted_by(query: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by query, then the greatest key, then the smallest document."""
    if not len(query):
        return np.zeros(0, np.int64)
    most = key.max()
    if not (most - key.min() < 2.0**40 and 0 <= query.min() and query.max() < 2**22):
        return np.lexsort((doc, -key, query))
    # Query and key as one number are sorted several times as fast; documents count where these are equal only.
    both = (query << 40) | (most - key).astype(np.int64)
    order = np.argsort(both)
    both = both[order]
    same = both[1:] == both[:-1]
    at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    order[at] = order[at][np.lexsort((doc[order[at]], both[at]))]
    return order


def cut(query: np.ndarray, key: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest keys of each query, ties to the smaller document, sorted by
    query; and the place of each."""
    order = sorted_by(query, key, doc)
    query, key, doc = query[order], key[order], doc[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = place < k
    return query[keep], key[keep], doc[keep], place[keep]


def likely(scores: np.ndarray, limits: np.ndarray, error: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of rough scores, off by `error` of their row at most, that
    can reach the limit of their row or be among its k best; none is lost but
    those below `least`."""
    low = limits - error
    fresh = np.flatnonzero(np.isneginf(low))
    if len(fresh) and scores.shape[1] > 2 * k:
        low[fresh] = np.partition(scores[fresh], -k, axis=1)[:, -k] - 2 * error[fresh] - 1 / SCALE
    low = np.maximum(low, least)
    rows = np.flatnonzero(scores.max(1) >= low)
    low = np.nextafter(low[rows].astype(scores.dtype), scores.dtype.type(-np.inf))
    row, column = np.divmod(np.flatnonzero(scores[rows] >= low[:, None]), scores.shape[1])
    return rows[row], column


class Best:
    """Scores count as rounded to DIGITS, halves away from zero."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.least = np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 2 * queries * k + SPARE

    def add(self, scores: np.ndarray, docs: np.ndarray, first: int = 0, valid: np.ndarray | None = None) -> None:
        """Scores of all these documents (columns) for the queries from `first` on
        (rows); greater is better.  Only `valid` ones count."""
        own = self.least[first : first + len(scores)]
        bound = self.limits(slice(first, first + len(scores)))
        if valid is not None:
            scores = np.where(valid, scores, -np.inf)
        if scores.shape[1] > 2 * self.k and np.isneginf(own).any():
            # As yet nothing is too low: what is below the k best of these is.
            bound = np.maximum(bound, np.partition(scores, -self.k, axis=1)[:, -self.k] - 1 / SCALE)
        mask = scores >= bound[:, None]
        if valid is not None:
            mask &= valid
        row, column = np.nonzero(mask)
        self.take(row + first, docs[column], scores[row, column], len(scores))

    def limits(self, rows: slice | np.ndarray) -> np.ndarray:
        """What a score of these queries must reach to count, but for rounding."""
        return (self.least[rows] - 1) / SCALE

    def take(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray, queries: int) -> None:
        """Single scores, of so many queries."""
        key = np.copysign(np.floor(np.abs(score) * SCALE + 0.5), score) + 0.0
        keep = key >= self.least[query]
        query, key, doc = query[keep], key[keep], doc[keep]
        if len(query) > 2 * self.k * queries:
            query, key, doc, place = cut(query, key, doc, self.k)
            last = place == self.k - 1
            self.least[query[last]] = np.maximum(self.least[query[last]], key[last])
        self.held.append((query, key, doc))
        self.size += len(query)
        if self.size > self.most:
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the best so far."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, key, doc, place = cut(*(np.concatenate(c) for c in zip(*self.held)), self.k)
        last = place == self.k - 1
        self.least[query[last]] = key[last]
        self.held, self.size = [(query, key, doc)], len(query)
        return query, doc, key / SCALE + 0.0


class Rough:
    """Scores in single precision of some rows of a task, held until the best by
    them are known, so that few are scored in double precision."""

    def __init__(self, best: Best):
        self.best = best
        #: What a query's rough scores are off by at most, and a score that k documents reach.
        self.off, self.low = np.zeros(best.queries), np.full(best.queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def limits(self) -> np.ndarray:
        """What a score of each query must reach to count, but for rounding."""
        return np.maximum(self.best.limits(slice(None)), self.low - 1 / SCALE)

    def add(self, query: np.ndarray, where: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, where, score))
        self.size += len(query)
        if self.size > self.best.most:
            self.cut()

    def cut(self) -> None:
        """Leaves out what is not among the best."""
        query, where, score = (np.concatenate(c) for c in zip(*self.held))
        # With the bits of negative ones turned, numbers in single precision are sorted as their bits are.
        bits = score.view(np.int32)
        bits = bits ^ ((bits >> 31) & 0x7FFFFFFF)
        order = np.argsort(query << 32 | (2**31 - 1 - bits.astype(np.int64)))
        query, where, score = query[order], where[order], score[order]
        first = np.searchsorted(query, np.arange(self.best.queries + 1))
        full = np.flatnonzero(np.diff(first) >= self.best.k)
        self.low[full] = np.maximum(self.low[full], score[first[full] + self.best.k - 1] - self.off[full])
        keep = score >= self.low[query] - self.off[query] - 2 / SCALE
        self.held = [(query[keep], where[keep], score[keep])]
        self.size = int(keep.sum())

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, where) of the best, sorted by where; nothing is held any more."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cut()
        query, where, _ = self.held[0]
        self.held, self.size = [], 0
        order = np.argsort(where)
        return query[order], where[order]
