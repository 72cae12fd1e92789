"""Plain versions of the operators, for comparison."""

import hashlib
import math
import re
from collections import Counter

import numpy as np


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, n, t):
    """Smallest reachable place of each text."""
    sets = [shingles(x, n) for x in texts]
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def removed(texts, length):
    """Which bytes of each text go."""
    blobs = [(x or "").encode() for x in texts]
    seen = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(x):
    return re.sub("[^0-9]", "", x)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) < 256 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(only_digits(x)) <= 19 and luhn(only_digits(x))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(only_digits(x)) <= 15),
]
SECRETS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PII for m in re.finditer(p, text or "") if ok(m[0])]


def secrets(text):
    found = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(SECRETS) for m in re.finditer(p, text or "") if ok(m))
    return [f"{SECRETS[i][0]}:{s}:{e}" for s, i, e in found]


def lloyd(rows, k, rounds, scale=1024, salt="3:"):
    """Plain rounds in Python integers over (id, components): per row (id, cluster, distance), and the centroids."""
    rows = [(i, [math.floor(x * scale) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), i, v) for i, v in rows if i is not None)
    centroids = [v for *_, v in named[:k]]
    for step in range(rounds + 1):
        near = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in rows]
        if step < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(rows, near, strict=True) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, n, d) for (i, _), (d, n) in zip(rows, near, strict=True)], centroids


def negatives(rows, is_anchor, positives=5, most=5, low=80, high=100, scale=256):
    """All pairs in Python integers over (id, label, components), ids distinct."""
    rows = [(i, label, [math.floor(x * scale) for x in v]) for i, label, v in rows]
    out = []
    for a, own, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, label == own) for i, label, w in rows if i != a)
        for p, i, _ in [x for x in scored if x[2]][:positives]:
            window = [x for x in scored if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:most]
            out += [(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(window, 1)]
    return sorted(out)
