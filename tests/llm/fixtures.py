"""Awkward documents for the training-data operators, and brute-force counterparts."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, end="."):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(n)) + end


def awkward():
    """(doc_id, text, n_words, n_chars, kept): extra columns carry names that the operators use themselves."""
    base = prose(1, 300)
    near = base.split(" ")
    near[40] = "changed"
    passage = prose(2, 120)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 80) + "\n" + passage + "\n" + prose(4, 80)),
        (5, prose(5, 90) + "\n" + passage), (6, passage + "\n" + prose(6, 70)), (7, None), (8, ""), (9, " \n\t "), (10, "one"),
        (11, "one"), (None, prose(7, 60)), (None, base), (12, prose(8, 60)), (12, prose(8, 60)), (12, prose(9, 60)),
        (13, "la la " * 400), (14, "a" * 3000), (15, "\n".join(["Home | About | Contact | Terms"] * 30)),
        (16, "BUY!! NOW!! CHEAP!! " * 30), (17, "Ünïcödé ßtraße İstanbul Σας 日本語 ÉCOLE. " * 20), (18, "x<|endoftext|>y  z\t\n\n w\x1f\x1cv."),
        (19, prose(10, 20_000)), (20, prose(11, 55) + "\n" + prose(11, 55)), (9007199254740993, prose(12, 51)),
    ]
    return [(i, t, "clash", None if t is None else len(t), True) for i, t in rows]


SCHEMA = "doc_id long, text string, n_words string, n_chars long, kept boolean"


def awkward_docs(spark, parts=3):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(parts)


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, k, per_cent=80):
    """[(n_shingles, component id)] of (doc_id, text) rows; links by full comparison."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= per_cent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def brute_repeats(rows, width):
    """(doc_id, n_bytes, n_removed, n_spans, digest) by counting every string of ``width`` bytes."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[p:p + width] for _, r in raws for p in range(len(r) - width + 1))
    out = []
    for d, r in raws:
        cover = np.zeros(len(r), bool)
        for p in range(len(r) - width + 1):
            if seen[r[p:p + width]] > 1:
                cover[p:p + width] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~cover])
        out.append((d, len(r), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
