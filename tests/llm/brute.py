"""Plain Python versions of the operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, width=5):
    w = lower_words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def components(rows):
    """[(id, text)] -> {id: (n_shingles, smallest id reachable)}."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        both = defaultdict(int)
        for s in sets[i]:
            for j in lists[s]:
                both[j] += 1
            lists[s].append(i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows, size=50):
    """[(id, text)] -> [(id, text as bytes, set of removed places)]; rows of equal id don't count against each other."""
    seen, out, waiting, last = set(), [], set(), None
    for i, t in sorted(rows, key=lambda r: r[0]):
        if i != last:
            seen |= waiting
            waiting, last = set(), i
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - size + 1):
            if b[p:p + size] in seen:
                gone.update(range(p, p + size))
            waiting.add(b[p:p + size])
        out.append((i, b, gone))
    return out
