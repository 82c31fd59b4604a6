"""Plain versions of the operators for small tables."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_duplicates(rows, percent=85):
    """rows: (doc_id, text). Per row (doc_id, n_shingles, component_id)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    posts = defaultdict(list)
    freq = Counter(h for s in {s for _, s in sets} for h in s)
    order = sorted(range(len(sets)), key=lambda k: len(sets[k][1]))
    for k in order:
        s = sets[k][1]
        if not s:
            continue
        prefix = sorted(s, key=lambda h: (freq[h], h))[: len(s) - -(-percent * len(s) // 100) + 1]
        for o in {o for h in prefix for o in posts[h]}:
            t = sets[o][1]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[find(k)] = find(o)
        for h in prefix:
            posts[h].append(k)
    least = {}
    for k, (i, s) in enumerate(sets):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def quality_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
