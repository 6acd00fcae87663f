"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib

import numpy as np


def suffix_digest(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """The same digest from a table of all windows, for tests on small inputs."""
    raws = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for raw in raws:
        for x in range(len(raw) - length + 1):
            count[raw[x:x + length]] = count.get(raw[x:x + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for x in range(len(raw) - length + 1):
            if count[raw[x:x + length]] > 1:
                gone[x:x + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-1][:-1])))) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def jaccard_components(texts: list[str | None], width: int = 4, num: int = 85, den: int = 100) -> list[int]:
    """The least row linked to each row, over all pairs."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(x) for x in range(len(texts))]
