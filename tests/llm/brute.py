"""Plain versions of the operators, for small tables."""

import re


def sets_of(rows, words):
    out = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        width = min(words, len(found))
        out[doc_id] = {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()
    return out


def least(nodes, linked):
    """Node -> least node reachable."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(rows, words, percent):
    sets = sets_of(rows, words)
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    links = [
        (a, b)
        for a, b in pairs
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = least(sets, links)
    return {d: (len(s), found[d], found[d] == d) for d, s in sets.items()}


def repeated_lines(rows, min_words):
    """(doc_id, place) of the lines in later copies of runs of min_words words."""
    docs = {}
    for doc_id, text in sorted(rows):
        lines = [(i, x.strip()) for i, x in enumerate((text or "").split("\n"))]
        docs[doc_id] = [(i, x) for i, x in lines if x]
    first, gone = {}, set()
    for doc_id, lines in docs.items():
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += len(lines[e][1].split())
                ends = [len(lines[i][1].split()) for i in (s, e)]
                if e > s and words - max(ends) >= min_words:
                    break  # longer runs hold shorter ones that cover their lines
                if words >= min_words:
                    key = tuple(x for _, x in lines[s : e + 1])
                    d, at = first.setdefault(key, (doc_id, s))
                    if d != doc_id or s > at + (e - s):
                        gone.update((doc_id, i) for i, _ in lines[s : e + 1])
    return gone
