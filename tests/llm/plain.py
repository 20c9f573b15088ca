"""Small cases, and what the operators compute written out plainly."""

import re
from itertools import combinations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id string"
WORDS = [f"w{i}" for i in range(60)]


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "web", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(sets, num, den):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(sets))]


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, fits) in enumerate(BASE) for m in pattern.finditer(text or "") if fits(m)]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def edit_distance(pattern, text):
    """Least distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)
