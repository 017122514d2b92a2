"""Plain versions of the operators' definitions."""

from __future__ import annotations

import math
import re
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(SPACE, t or "")


def jaccard_classes(rows):
    sets = {}
    for d, t in rows:
        w = split(lower(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return [(d, len(sets[d]), root(d)) for d, _ in rows]


def repeats(rows, window=35):
    seen = Counter()
    for _, t in rows:
        w = split(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def plain_rules(t):
    w = split(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if split(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), failed


def kneser_ney_bigrams(train, vocabulary):
    """P(word | before) of an interpolated modified Kneser-Ney bigram model of token lists, as a function."""
    pairs = Counter()
    for tokens in train:
        pairs.update(zip(["<s>", *tokens], tokens, strict=False))

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.0, 0.5, 0.75, 1.0]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[2] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] and n[3] else 1.5]
        return [0.0] + [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]

    left = Counter(b for _, b in pairs)
    d2, d1 = discounts(pairs.values()), discounts(left.values())

    def step(count, counts, d, lower_p):
        total = sum(counts)
        if not total:
            return lower_p
        gamma = sum(d[min(c, 3)] for c in counts) / total
        return max(count - d[min(count, 3)], 0) / total + gamma * lower_p

    after: dict = {}
    for (a, _), c in pairs.items():
        after.setdefault(a, []).append(c)

    def p(before, word):
        p1 = step(left.get(word, 0), list(left.values()), d1, 1 / (vocabulary + 1))
        return step(pairs.get((before, word), 0), after.get(before, []), d2, p1)

    return p


def kneser_ney(texts, order, vocabulary):
    """P(w | the order - 1 before) of an interpolated modified Kneser-Ney model of padded sequences, as a function of an n-gram."""
    grams = {order: Counter(tuple(t[i : i + order]) for t in texts for i in range(len(t) - order + 1))}
    for m in range(order - 1, 0, -1):
        grams[m] = Counter(g[1:] for g in grams[m + 1])
    after = {m: {} for m in grams}
    for m in grams:
        for g, c in grams[m].items():
            after[m].setdefault(g[:-1], []).append(c)
    discounts = {}
    for m in grams:
        n = [sum(c == k for c in grams[m].values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            discounts[m] = [0.0, 0.5, 0.75, 1.0]
            continue
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[2] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] and n[3] else 1.5]
        discounts[m] = [0.0] + [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]

    def p(gram):
        value = 1 / (vocabulary + 1)
        for m in range(1, order + 1):
            g, d = gram[-m:], discounts[m]
            counts = after[m].get(g[:-1], [])
            if counts:
                c = grams[m].get(g, 0)
                value = max(c - d[min(c, 3)], 0) / sum(counts) + sum(d[min(x, 3)] for x in counts) / sum(counts) * value
        return value

    return p


def byte_perplexities(rows, order=5):
    """log10 perplexity per byte and end of each text under the model of all of them; None without bytes."""
    padded = [[0] * (order - 1) + list((t or "").encode()) + [255] for _, t in rows]
    p = kneser_ney(padded, order, 256)
    out = []
    for t in padded:
        n = len(t) - order + 1
        out.append(-sum(math.log10(p(tuple(t[i : i + order]))) for i in range(n)) / n if n > 1 else None)
    return out


def percentile(values, q):
    """The smallest value with at least a share q at or below it."""
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)]


def quality_bands(measured, low=8.0, high=4.0, least=0.02, full=200):
    """(lowest, highest log perplexity) for each (language, bytes, log perplexity)."""
    out = []
    for lang, size, _ in measured:
        own = [(n, s) for g, n, s in measured if g == lang]
        scored, long = [s for _, s in own if s is not None], [s for n, s in own if n >= full]
        most = 2 * len(long) >= len(scored)
        if not scored:
            out.append((None, None))
            continue
        middle = percentile(long if most else scored, 0.5)
        off = [(s - middle) * min(max(n, 1), full) / full for n, s in own if s is not None and (n >= full or not most)]
        width = max((percentile(off, 0.75) - percentile(off, 0.25)) / 1.349, least / low) / (min(max(size, 1), full) / full)
        out.append((middle - low * width, middle + high * width))
    return out


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_licences(t):
    """(words, places, first, last, labels) of the base phrases."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))
