"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k=5):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def roots(nodes, links):
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


def near_duplicates(rows, percent=85, k=5):
    """{doc_id: (n_shingles, component)} by counting shared shingles of all pairs."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    shared = defaultdict(int)
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), i in shared.items() if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i)]
    component = roots(sets, links)
    return {d: (len(sets[d]), component[d]) for d in sets}


def repeated_words(rows, least=50):
    """{doc_id: word indexes in a run of ``least`` words that some document of smaller doc_id holds}."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        words = WORD.findall(t or "")
        grams = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        hit = set()
        for i, g in enumerate(grams):
            if g in seen:
                hit.update(range(i, i + least))
        out[d] = hit
        seen.update(grams)
    return out


def backoff_scores(rows, order=2):
    """{doc_id: (n_words, log_score)} by the definition, counts of other documents only."""
    import math
    from collections import Counter

    texts = {d: tuple(WORD.findall((t or "").translate(ASCII_LOWER))) for d, t in rows}
    own = {d: Counter(w[i : i + n] for n in range(1, order + 1) for i in range(len(w) - n + 1)) for d, w in texts.items()}
    total = sum(own.values(), Counter())
    words = sum(map(len, texts.values()))
    out = {}
    for d, w in texts.items():
        score = 0.0
        for i in range(len(w)):
            n, penalty = min(order, i + 1), 0.0
            while n > 1 and total[w[i - n + 1 : i + 1]] <= own[d][w[i - n + 1 : i + 1]]:
                n, penalty = n - 1, penalty + math.log(0.4)
            gram = w[i - n + 1 : i + 1]
            if n > 1:
                score += penalty + math.log((total[gram] - own[d][gram]) / (total[gram[:-1]] - own[d][gram[:-1]]))
            else:
                score += penalty + math.log(max(total[gram] - own[d][gram], 0.5) / max(words - len(w), 1))
        out[d] = (len(w), score)
    return out


LETTERS = re.compile("[A-Za-z\x80-\U0010ffff]+")


def quality_features(text):
    """The hashed features of a text, by its definition: letter runs, shapes, and three shares in tenths."""
    import numpy as np

    from pulsegrid.llm import quality
    from pulsegrid.llm.text import LOWER, TABLE, U, mix, spans

    def hashed(s, table=TABLE):
        data = np.frombuffer(s if isinstance(s, bytes) else s.encode(), np.uint8)
        return spans(data, np.array([0]), np.array([len(data)]), table)

    def kind(b):
        c = chr(b)
        return "x" if b >= 128 or "a" <= c <= "z" else "X" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "\0" if b < 33 or b == 127 else c

    mask, out = U((1 << quality.BITS) - 1), set()
    words = WORD.findall(text or "")
    for run in LETTERS.findall(text or ""):
        out.add(int((hashed(run, LOWER) & mask)[0]))
    shapes = []
    for w in words:
        kinds = [kind(b) for b in w.encode()]
        shapes.append("".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k))
        out.add(int((mix(hashed(shapes[-1]) ^ U(1)) & mask)[0]))
    if words:
        shares = (sum(s in quality.PLAIN for s in shapes), sum(a == b for a, b in zip(words, words[1:])), len(set(words)))
        for tag, n in zip((11, 12, 13), shares):
            out.add(int((mix(np.array([math.ceil(n / len(words) * 10)], np.uint64) + U(tag * 1000)) & mask)[0]))
    return out
