"""The operators' contracts said again, plainly, for a few documents at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(t: str | None) -> str:
    return (t or "").translate(UPPER)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def removed(texts: list[str | None], length: int):
    """n_bytes, n_removed, n_spans and the hash of what is left, per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def line_dedup(docs: list[tuple[int | None, str | None]], min_words: int, hashes: list[int]) -> list[str | None]:
    """Texts without later copies of runs of lines; hashes are of the texts and break ties of ids."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, hashes[i]))
    seen: dict = {}
    gone: dict = defaultdict(set)
    for i in order:
        if docs[i][1] is None:
            continue
        key = (docs[i][0], docs[i][1])  # rows equal in both are one document
        lines = [(k, x) for k, x in enumerate(docs[i][1].split("\n")) if words(x)]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(words(x)) for x in run) < min_words:
                    continue
                first = seen.setdefault(run, (key, a))
                if first != (key, a):
                    gone[key].update(k for k, _ in lines[a:b])
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[key, t]) for key, t in docs]


def targets(sizes: dict[str | None, int], weights=(3, 1, 2), percent=150, most=2) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) * percent / 100 - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: float(most * sizes[s]) if s in full else weight[s] * left / share for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def phrases(t: str | None):
    """n_words, n_base, first, last, labels."""
    ws = alnum(t)
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def fingerprint(t: str | None) -> int:
    ws = words(lower(t))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps: list[int], distance: int = 3) -> list[int]:
    """For each the least place that it reaches."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def quality(t: str | None) -> dict:
    ws = words(t)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in t or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": sum(c.isupper() and c.isalpha() for c in t or ""), "n_exclaims": (t or "").count("!"), "n_distinct": len(set(ws)),
        "n_letters": sum(c.isalpha() for c in t or ""), "n_marked": sum(any(c in "#*$%&|<>" for c in w) for w in ws),
    }


def trained(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


class Katz:
    """n-grams with Katz backoff, from the formulas alone: Good-Turing up to `most`, an absolute discount above."""

    def __init__(self, docs: list[tuple[int | None, str | None]], order: int = 3, most: int = 5):
        self.order, self.most = order, most
        self.counts: list[Counter] = [Counter() for _ in range(order + 1)]
        self.history: list[Counter] = [Counter() for _ in range(order)]
        self.followers: dict = {}
        for key, t in docs:
            if trained(key):
                x = self.padded(t)
                for i in range(order - 1, len(x)):
                    for n in range(1, order + 1):
                        h, w = tuple(x[i - n + 1 : i]), x[i]
                        self.counts[n][h + (w,)] += 1
                        if n > 1:
                            self.history[n - 1][h] += 1
                            self.followers.setdefault(h, set()).add(w)
        self.c = {g[0]: c for g, c in self.counts[1].items()}
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.keeps = [None, *[self.turing(Counter(self.counts[n].values())) for n in range(1, order + 1)]]
        self.weights: dict = {}

    def padded(self, t):
        return ["<s>"] * (self.order - 1) + self.tokens(t)

    def tokens(self, t):
        return [*words(lower(t)), "</s>"]

    def turing(self, n):
        """What a count keeps: r* = (r + 1) n[r + 1] / n[r], with Katz's correction so that counts above `most` are let be."""
        back = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

        def keep(r):
            if r > self.most or not n[1] or not n[r]:
                return r - back
            star = (r + 1) * n[r + 1] / n[r]
            beyond = (self.most + 1) * n[self.most + 1] / n[1]
            if beyond >= 1:
                return r - back
            d = (star / r - beyond) / (1 - beyond)
            return r * d if 0 < d < 1 else r - back

        return keep

    def p(self, h: tuple, w) -> float:
        n = len(h) + 1
        c = self.counts[n][h + (w,)]
        if n == 1:
            return self.keeps[1](c) / self.n if c else 1 - sum(self.keeps[1](x) for x in self.c.values()) / self.n if self.n else 1.0
        if c:
            return self.keeps[n](c) / self.history[n - 1][h]
        if not self.history[n - 1][h]:
            return self.p(h[1:], w)
        return self.bow(h) * self.p(h[1:], w)

    def bow(self, h: tuple) -> float:
        if h not in self.weights:
            seen = self.followers[h]
            self.weights[h] = (1 - sum(self.p(h, w) for w in seen)) / (1 - sum(self.p(h[1:], w) for w in seen))
        return self.weights[h]

    def score(self, t) -> tuple[int, int, float, float]:
        ws = self.tokens(t)
        x = self.padded(t)
        base = sum(math.log10((self.c.get(w, 0) + 1) / (self.n + self.v + 1)) for w in ws)
        return len(ws), sum(w in self.c for w in ws), base, sum(math.log10(self.p(tuple(x[i - self.order + 1 : i]), x[i])) for i in range(self.order - 1, len(x)))


def contamination(t: str | None, items: list[tuple[str, str | None]], window: int = 10):
    """n_words, n_hit, items, of one text."""
    ws = alnum(t)
    hit, found = set(), set()
    for item, text in items:
        iw = alnum(text)
        size = min(window, len(iw))
        if not size:
            continue
        for g in {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}:
            for i in range(len(ws) - size + 1):
                if tuple(ws[i : i + size]) == g:
                    hit.update(range(i, i + size))
                    found.add(item or "")
    return len(ws), len(hit), sorted(found)
