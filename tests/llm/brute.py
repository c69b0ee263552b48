"""Plain answers to small inputs, written for clearness only."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def word_sets(texts: dict, width: int) -> dict:
    out = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if len(words) >= width:
            out[i] = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)}
        else:
            out[i] = {tuple(words)} if words else set()
    return out


def jaccard(texts: dict, width: int, percent: int) -> dict:
    sets = word_sets(texts, width)
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def repeats(texts: list, depth: int) -> list:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                cover[i : i + depth] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~cover])
        out.append((len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_spans(text: str) -> list:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def near(rows: list, threshold: float) -> dict:
    """(links, component) by position of (id, vector)."""
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, pairs = Counter(), []
    for i, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows):
            if i < j and fine(v) and fine(w) and len(v) == len(w):
                v_, w_ = np.array(v, dtype=float), np.array(w, dtype=float)
                if v_ @ w_ / np.sqrt((v_ @ v_) * (w_ @ w_)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((a, b))
    found = components([a for a, _ in rows], pairs)
    return {i: (links[i], found[a]) for i, (a, _) in enumerate(rows)}


def top_k(data: list, asked: list, k: int) -> set:
    out = set()
    for q, v in asked:
        scores = []
        for i, w in data:
            if i != q and w is not None and len(w) == len(v):
                scores.append((-sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(v, w)), i))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out
