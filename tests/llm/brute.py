"""The contracts of the llm operators once more, in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, width: int = 5) -> set:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    """doc_id: size of its set, smallest doc_id reachable, whether that is itself."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    both = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def suffix_dedup(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def held_out(doc: int | None) -> bool:
    return zlib.crc32(str(doc).encode()) % 7 == 2


def base_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    """doc_id: held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = {d: [*words(t), None] for d, t in docs}
    seen = Counter(x for d, own in tokens.items() if not held_out(d) for x in own)
    n, v = seen.total(), len(seen)
    return {d: (held_out(d), len(own), sum(seen[x] > 0 for x in own), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in own)) for d, own in tokens.items()}


class Katz:
    """Bigrams that back off to words, and words to all that training has not seen."""

    def __init__(self, docs: list[tuple[int, str | None]], least: int, most: int):
        self.pairs, self.uni, self.after = Counter(), Counter(), Counter()
        for d, t in docs:
            if not held_out(d):
                own = ["<s>", *words(t), "</s>"]
                self.uni.update(own[1:])
                self.after.update(own[:-1])
                self.pairs.update(zip(own[:-1], own[1:], strict=True))
        self.total = self.uni.total()
        self.d1 = self.factors(self.uni, 1, most)
        self.d2 = self.factors(self.pairs, least, most)
        self.unseen = 1 - sum(self.d1.get(c, 1.0) * c for c in self.uni.values()) / max(self.total, 1)
        if self.unseen < 1e-12:  # nothing discounted: an unseen word counts as one more
            self.unseen, self.total = 1 / (self.total + 1), self.total + 1
        self.kept = defaultdict(dict)
        for (h, w), c in self.pairs.items():
            if c >= least:
                self.kept[h][w] = self.d2.get(c, 1.0) * c / self.after[h]
        for h, own in self.kept.items():
            n = self.after[h]
            most_mass = n / (n + 1)
            if (mass := sum(own.values())) > most_mass:
                self.kept[h] = {w: p * most_mass / mass for w, p in own.items()}

    @staticmethod
    def factors(counts: Counter, least: int, most: int) -> dict[int, float]:
        of = Counter(counts.values())
        tail = (most + 1) * of[most + 1] / of[1] if of[1] else 1.0
        out = {}
        for r in range(1, most + 1):
            d = ((r + 1) * of[r + 1] / (r * of[r]) - tail) / (1 - tail) if of[r] and tail != 1 else 0.0
            out[r] = 0.0 if r < least else d if 0 < d < 1 else (r - 0.5) / r
        return out

    def word(self, w: str) -> float:
        c = self.uni[w]
        return self.d1.get(c, 1.0) * c / self.total if c else self.unseen

    def prob(self, h: str, w: str) -> float:
        own = self.kept.get(h)
        if not own:
            return self.word(w)
        if w in own:
            return own[w]
        return (1 - sum(own.values())) / (1 - sum(self.word(x) for x in own)) * self.word(w)

    def score(self, text: str | None) -> float:
        own = ["<s>", *words(text), "</s>"]
        return sum(math.log10(self.prob(h, w)) for h, w in zip(own[:-1], own[1:], strict=True))


def top_scores(vectors: list[tuple[int, list | None]], top: int = 20, every: int = 20) -> set[tuple[int, int, int, int]]:
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = np.floor(64.0 * np.array(v, dtype=np.float64)).astype(np.int64)
    out = set()
    for q in whole:
        if q % every == 0:
            ranked = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:top]
            out |= {(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)}
    return out
