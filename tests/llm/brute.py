"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontamination(docs, items, window=8):
    patterns = defaultdict(set)
    for item, text in items:
        if item is None:
            continue
        w = WORDS.findall(lower(text))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns[tuple(w[i : i + m])].add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w = WORDS.findall(lower(text))
        hit, names = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if found := patterns.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / w for s in order} if w else {s: cap * sizes[s] for s in order}
        more = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not more:
            return target
        full |= more


def quality_base(text):
    text = text or ""
    words = SPACES.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACES.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def shingles(text, width=5):
    w = SPACES.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(docs):
    """docs: [(doc_id, text)] -> [(doc_id, n_shingles, component_id)]."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            held[x].append(i)
    for i, (_, s) in enumerate(sets):
        common = Counter(j for x in s for j in held[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)]
