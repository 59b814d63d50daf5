"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import regex
import xxhash
import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_groups(rows, width, part, whole):
    """{doc_id: (n, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {p for held in holders.values() for p in combinations(sorted(held), 2)}
    links = [(a, b) for a, b in pairs if whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def dedup_lines(rows, least=12):
    """{doc_id: (n_lines, n_removed, text)}; a line is held against all earlier ones."""
    lines = [
        (i, n, line.strip(" \t\x0b\x0c\r")) for i, t in sorted(rows) if t is not None for n, line in enumerate(t.split("\n"))
    ]
    gone, seen = defaultdict(set), []
    for i, n, line in lines:
        if len(line) >= least:
            if any(line == s or within_one(line, s) for s in seen):
                gone[i].add(n)
            seen.append(line)
    out = {}
    for i, t in rows:
        own = t.split("\n") if t is not None else []
        kept = [x for n, x in enumerate(own) if n not in gone[i]]
        out[i] = (len(own), len(gone[i]), "\n".join(kept) if gone[i] else t)
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target} by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sizes if s not in capped)
        level = rest / open_ if open_ else 0
        above = {s for s in sizes if s not in capped and weight[s] * level > cap * sizes[s]}
        if not above:
            return {s: float(cap * sizes[s]) if s in capped else weight[s] * level for s in sizes}
        capped |= above


def mixed(rows):
    """{doc_id: (size, target, taken, copies)} of (doc_id, source, text)."""
    sizes, docs = defaultdict(int), defaultdict(list)
    for i, s, t in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        docs[s].append((hashlib.md5(str(i).encode()).hexdigest(), n, i))
    goal, out = targets(sizes), {}
    for s, own in docs.items():
        budget, start = int(goal[s]), 0
        for _, n, i in sorted(own):
            parts = [min(n, max(0, budget - k * sizes[s] - start)) for k in range(3)]
            out[i] = (n, goal[s], sum(parts), sum(p > 0 for p in parts))
            start += n
    return out


# Classifiers.  `texts` is a dict of texts by id, `marks` one of labels by id.


def spark_hash(i):
    """Spark's xxhash64 of a long, as a signed number."""
    return int.from_bytes(xxhash.xxh64(struct.pack("<q", i), seed=42).digest(), "big", signed=True)


def by_class(texts, marks):
    chosen = sorted((i for i in marks if i in texts and texts[i] is not None), key=lambda i: (spark_hash(i), i))
    return {v: [texts[i] for i in chosen if marks[i] == v] for v in (0, 1)}


def least_squares_rising(values, labels, weights):
    """For each distinct value the isotonic fit, by its minimax formula."""
    groups = sorted(set(values))
    w, y = (
        np.array([sum(b for a, b in zip(values, column) if a == g) for g in groups])
        for column in (weights, [w * t for w, t in zip(weights, labels)])
    )
    cw, cy = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(y)])
    fit = []
    for i in range(len(groups)):
        fit.append(max(min((cy[b] - cy[a]) / (cw[b] - cw[a]) for b in range(i + 1, len(groups) + 1)) for a in range(i + 1)))
    return groups, w, fit


def quality_scores(texts, marks):
    own = by_class(texts, marks)

    def dictionary(ts):
        blocks = [t.encode()[i : i + 512] for t in ts for i in range(0, len(t.encode()), 512)]
        return zstandard.train_dictionary(112_640, blocks)

    def pair(halves):
        lines = {v: set("\n".join(ts).split("\n")) for v, ts in halves.items()}
        common = lines[0] & lines[1]
        return [dictionary(["\n".join(x for x in t.split("\n") if x not in common) for t in halves[v]]) for v in (1, 0)]

    def difference(text, pair):
        data = text.encode()
        sizes = []
        for d in pair:
            tool = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(tool.compress(data[i : i + 512])) for i in range(0, len(data), 512)))
        return (sizes[1] - sizes[0]) / (sum(sizes) + 20)

    values, labels = [], []
    for half in (0, 1):
        tools = pair({v: own[v][half::2] for v in (0, 1)})
        for v in (0, 1):
            for t in own[v][1 - half :: 2]:
                values.append(difference(t, tools))
                labels.append(v)
    n = {v: sum(m == v for m in marks.values()) for v in (0, 1)}
    raw = [n[y] / labels.count(y) for y in labels]
    weights = [w * len(labels) / sum(raw) for w in raw]
    groups, w, fit = least_squares_rising(values, labels, weights)
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    at, chance, i = [], [], 0
    while i < len(groups):  # pools of equal fit
        j = i
        while j < len(groups) and abs(fit[j] - fit[i]) < 1e-12:
            j += 1
        weight = sum(w[i:j])
        at.append(sum(g * x for g, x in zip(groups[i:j], w[i:j])) / weight)
        chance.append((fit[i] * weight + share) / (weight + 1))
        i = j
    for i in range(1, len(chance)):
        chance[i] = max(chance[i], chance[i - 1])
    tools = pair(own)

    def score(text):
        x = difference(text or "", tools)
        if x <= at[0]:
            return chance[0]
        for (a, p), (b, q) in zip(zip(at, chance), zip(at[1:], chance[1:])):
            if x <= b:
                return p + (q - p) * (x - a) / (b - a)
        return chance[-1]

    return {i: score(t) for i, t in texts.items()}


def toxicity_scores(texts, marks, words_of):
    """Words are folded by the given function; everything else is worked out by scanning words."""
    own = {v: list(dict.fromkeys(ts)) for v, ts in by_class(texts, marks).items()}
    every = by_class(texts, marks)
    half_of = {t: xxhash.xxh64(t.encode(), seed=42).intdigest() % 2 for ts in own.values() for t in ts}
    words = {t: words_of(t) for t in half_of}

    def stems(w):
        return [" " + w[:n] for n in (4, 5, 6) if len(w) >= n]

    def learned(keep):
        sets = {v: [set(words[t]) for t in ts if keep(half_of[t])] for v, ts in own.items()}
        n1, n0 = len(sets[1]), len(sets[0])
        held = {v: defaultdict(int) for v in (0, 1)}
        for v, documents in sets.items():
            for document in documents:
                entries = {f" {w} " for w in document} | {" " + w[:n] for w in document for n in (4, 5, 6) if len(w) > n}
                for e in entries:
                    held[v][e] += 1
        weights = {}
        for e, c in held[1].items():
            weight = math.log((c + 0.5) / (n1 + 1)) - math.log((held[0][e] + 0.5) / (n0 + 1))
            if c >= max(3, 0.01 * n1) and weight >= 2.5:
                weights[e] = weight
        for length in sorted({len(e) for e in weights}, reverse=True):
            for e in [e for e in weights if len(e) == length]:
                shorter = [e[: n + 1] for n in (4, 5, 6) if n + 1 < len(e)]
                if any(x in weights and weights[x] >= weights[e] for x in shorter):
                    del weights[e]
        best = sorted(weights, key=lambda e: (-weights[e] * held[1][e], e))[:2000]
        weights = {e: weights[e] for e in best}
        pairs = {v: defaultdict(int) for v in (0, 1)}
        is_hit = lambda w: f" {w} " in weights or any(x in weights for x in stems(w))
        for v, ts in own.items():
            for t in ts:
                if keep(half_of[t]):
                    for p in {p for p in zip(words[t], words[t][1:]) if is_hit(p[0]) or is_hit(p[1])}:
                        pairs[v][p] += 1
        exceptions = {p for p, c in pairs[0].items() if c >= 3 and c / max(n0, 1) > pairs[1][p] / max(n1, 1)}
        return weights, exceptions

    def features(ws, lexicon):
        weights, exceptions = lexicon
        total = 0.0
        for i, w in enumerate(ws):
            found = [weights[e] for e in [f" {w} ", *stems(w)] if e in weights]
            around = {(ws[i - 1] if i else "", w), (w, ws[i + 1] if i + 1 < len(ws) else "")}
            if found and not around & exceptions:
                total += max(found)
        return [math.log1p(total), min(total, 25.0), total / (len(ws) + 20), math.log1p(len(ws))]

    halves = [learned(lambda h, k=k: h == k) for k in (0, 1)]
    rows = [(features(words[t], halves[1 - half_of[t]]), v) for v in (0, 1) for t in every[v]]
    x, y = np.array([r for r, _ in rows]), np.array([v for _, v in rows], float)
    # Ridge logistic regression on balanced classes by gradient steps of Newton's method until nothing moves.
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    design = lambda f: np.column_stack([np.ones(len(f)), (f - mean) / scale])
    d, n = design(x), len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    beta = np.zeros(d.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-d @ beta))
        gradient = d.T @ (weight * (y - p)) - 1e-3 * n * beta
        hessian = d.T @ (d * (weight * p * (1 - p))[:, None]) + 1e-3 * n * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, gradient)
    n1 = sum(v == 1 for v in marks.values())
    shift = math.log((n1 + 1) / (len(marks) - n1 + 1))
    whole = learned(lambda h: True)
    out = {}
    for i, t in texts.items():
        z = shift + (design(np.array([features(words_of(t or ""), whole)])) @ beta)[0]
        out[i] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return out


def license_scan(rows, templates, threshold, name, marker, token, blank, comments, spdx, spdx_name, spdx_term):
    """{id: (license, score, origin, from_dir)} of rows (id, path, text)."""
    plain = lambda p: regex.compile(p.replace("(?md)", "(?m)"))
    marked = lambda parts: [p for p in parts if re.search(marker, p)]
    units = {}
    for i, path, text in rows:
        named = path is not None and re.search(name, path.split("/")[-1]) is not None
        if text is None or not (named or re.search(marker, text)):
            continue
        lines, paragraphs = marked(text.split("\n")), marked(plain(blank).split(text))
        remarks = marked([m.group(0) for c in comments for m in plain(c).finditer(text)])
        parts = ([text] if named else []) + ["\n".join(lines), *lines, "\n\n".join(paragraphs), *paragraphs, *remarks]
        names = [n for x in re.findall(spdx, text.lower()) for n in re.findall(spdx_name, x) if n not in ("and", "or", "with")]
        units[i] = {p.strip(" ") for p in parts} | {spdx_term + re.sub("-(only|or-later)$", "", n) for n in names}
    count = lambda text: Counter(re.findall(token, text.lower()))
    own = [(i, c) for i, texts in units.items() for c in map(count, texts) if c]
    known = [(t, count(t[1])) for t in templates]
    df = Counter(term for _, c in [*own, *known] for term in c)
    idf = {term: math.log((1 + len(own) + len(known)) / (1 + n)) + 1 for term, n in df.items()}
    weigh = lambda c: {term: n * idf[term] for term, n in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    known, best = [(t, w, norm(w)) for t, w in ((t, weigh(c)) for t, c in known)], {}
    for i, c in own:
        w = weigh(c)
        for (license, _, place, least), k, size in known:
            score = round(sum(x * k[term] for term, x in w.items() if term in k) / (norm(w) * size), 6)
            if score >= max(threshold, least):
                best[i] = min(best.get(i, (9,)), (place, -score, license))
    folder = lambda path: path.rpartition("/")[0]
    stated = {}
    for i, path, _ in rows:
        if i in best and path is not None and re.search(name, path.split("/")[-1]):
            stated[folder(path)] = min(stated.get(folder(path), (9,)), best[i][1:])
    out = {}
    for i, path, _ in rows:
        at = None if path is None else folder(path)
        while at and at not in stated:
            at = folder(at)
        if i in best:
            out[i] = (best[i][2], -best[i][1], "own", None)
        elif at is not None and at in stated:
            out[i] = (stated[at][1], -stated[at][0], "inherited", at)
        else:
            out[i] = (None, None, None, None)
    return out
