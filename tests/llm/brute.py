"""The stages once more, in plain Python over small tables."""

import math
import re
from collections import Counter

import numpy as np

from semlake.llm import toxicity
from semlake.llm.bytewords import mix

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(text):
    """Of each distinct word the places of its n-grams, one for each position."""
    words = set(re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").translate(UPPER).encode()))
    out = []
    for w in words:
        marked = b" " + w + b" "
        grams = [(n, marked[i : i + n]) for n in toxicity.SIZES for i in range(len(marked) - n + 1)]
        codes = np.array([int.from_bytes(g, "little") * 8 + n for n, g in grams], np.uint64)
        out.append((mix(codes) >> np.uint64(64 - toxicity.BITS)).tolist())
    return out


def ratios(texts, labels):
    """(counts of other, counts of toxic, log ratios before the gate)."""
    sums = [Counter(), Counter()]
    for t, y in zip(texts, labels, strict=True):
        for word in places(t):
            sums[y].update(word)
    q, p = (np.array([s[i] + 1.0 for i in range(toxicity.PLACES)]) for s in sums)
    return q - 1, p - 1, np.log(p / p.sum()) - np.log(q / q.sum())


def score(text, model):
    weights, intercept = np.asarray(model[0], np.float32), model[1]
    words = places(text)
    z = intercept + sum(float(weights[i]) for w in words for i in w) / math.sqrt(max(1, len(words)))
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def kept_lines(texts, least=10):
    keys = [[line.strip(" \t\n\v\f\r").translate(UPPER) for line in (t or "").split("\n")] for t in texts]
    many = Counter(k for ks in keys for k in set(ks) if k)
    return [None if t is None else "\n".join(line for line, k in zip(t.split("\n"), ks, strict=True) if not k or many[k] < least) for t, ks in zip(texts, keys, strict=True)]


def near_kept(texts, percent=80, n=5):
    """Positions of the texts that stay: the least of each class."""
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", (t or "").translate(UPPER)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [i for i in range(len(texts)) if find(i) == i]


def contaminated(text, items, n=10):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(UPPER))
    mine = words(text)
    for item in map(words, items):
        k = min(n, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        if any(tuple(mine[i : i + k]) in windows for i in range(len(mine) - k + 1)):
            return True
    return False
