"""Plain restatements of what the operators must return, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text: str | None):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    spans = sorted((a, n, k, b) for n, (k, v) in enumerate(found.items()) for a, b in v)
    return {k: len(v) for k, v in found.items()}, ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def licenses(text: str | None):
    w = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def contamination(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(i)
    sizes = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def exact(docs):
    groups = defaultdict(list)
    keyed = [(d, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for d, t in docs]
    for d, t in keyed:
        groups[t].append(d)
    keep = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return [(d, keep[t], len(groups[t]), sha(t)) for d, t in keyed]


def simhash(docs, radius=4):
    fps = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 4 else ([" ".join(w)] if w else [])
        c = [0] * 64
        for s in sh:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                c[b] += h >> b & 1
        fps.append(sum(1 << b for b in range(64) if 2 * c[b] > len(sh)))
    best = [d for d, _ in docs]
    changed = True
    while changed:
        changed = False
        for a in range(len(docs)):
            for b in range(len(docs)):
                if (fps[a] ^ fps[b]).bit_count() <= radius and best[b] is not None and (best[a] is None or best[b] < best[a]):
                    best[a], changed = best[b], True
    return [(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, best, strict=True)]


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def line_sims(norm):
    """The two SimHashes of a line (of words, of pairs of characters), where it has them: 64 bits and 31 further ones."""
    words = norm.split(" ")
    out = []
    for has, features in ((len(words) >= 9, set(words)), (len(words) < 12, {norm[k : k + 2] for k in range(max(1, len(norm) - 1))})):
        count = [0] * 128
        for x in features:
            h = xxhash.xxh3_128_digest(x.encode())
            for b in range(128):
                count[b] += h[b // 8] >> b % 8 & 1
        bits = sum(1 << b for b in range(128) if 2 * count[b] > len(features))
        out.append((bits & (1 << 64) - 1, bits >> 64 & (1 << 31) - 1) if has else None)
    return out


def line_dedup(docs, radius=8, more=7, near=None):
    """docs: (doc_id, text), no two equal. The lines of each that go. near: a condition instead of that on SimHashes."""
    order = lambda d: (d is None, d)
    found: dict[str, list] = {}
    for d, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if norm := re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line.lower()).strip(" "):
                found.setdefault(norm, []).append((order(d), k, d))
    names = list(found)
    sims = {n: line_sims(n) for n in names}
    close = lambda x, y: x and y and (x[0] ^ y[0]).bit_count() <= radius and (x[1] ^ y[1]).bit_count() <= more
    near = near or (lambda a, b: any(close(x, y) for x, y in zip(sims[a], sims[b], strict=True)))
    root = {n: n for n in names}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            most = max(len(a), len(b))
            if abs(len(a) - len(b)) * 5 <= most and top(a) != top(b) and near(a, b) and edits(a, b) * 5 <= most:
                root[top(a)] = top(b)
    gone: dict = {}
    parts: dict[str, list] = {}
    for n in names:
        parts.setdefault(top(n), []).extend(found[n])
    for places in parts.values():
        for _, k, d in sorted(places, key=lambda x: (x[0][0], x[0][1] or 0, x[1]))[1:]:
            gone.setdefault(d, set()).add(k)
    return gone
