"""Plain re-statements of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def similar_groups(rows):
    """Row number -> (set size, group's smallest row number)."""
    sets = [shingles(t) for t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
             if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    group = roots(pairs, range(len(rows)))
    return {i: (len(sets[i]), group[i]) for i in range(len(rows))}


def repeats(rows, span=50):
    """(id, text) rows -> covered flags of every byte."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            first[b[p:p + span]] = min(first.get(b[p:p + span], math.inf), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        flags = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p:p + span]] < key(i):
                flags[p:p + span] = b"\1" * span
        out.append(flags)
    return out


def passages(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(text, items, span=10):
    """(words, words hit, sorted ids of items that occur)."""
    w, hit, found = passages(text), set(), set()
    for item_id, item in items:
        b = passages(item)
        n = min(span, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p:p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item_id)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def context_tree(train, depth=5):
    """Counts of every node: (context, decisions so far) -> [zeros, ones]."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        for context, symbol in steps(text, depth):
            for d in range(depth + 1):
                for k in range(8):
                    counts[context[depth - d:], format(symbol, "08b")[:k]][symbol >> (7 - k) & 1] += 1
    return counts


def steps(text, depth):
    padded = b"\xff" * depth + text + b"\xff"
    for i in range(len(text) + 1):
        yield padded[i:i + depth], padded[i + depth]


def kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)


def tree_scores(train, texts, depth=5):
    counts = context_tree(train, depth)
    below = defaultdict(float)
    weighted, share = {}, {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[context, node])
        if len(context) == depth:
            weighted[context, node] = own
        else:
            low = below[context, node]
            high = max(own, low)
            weighted[context, node] = math.log(.5) + high + math.log(math.exp(own - high) + math.exp(low - high))
            share[context, node] = math.exp(math.log(.5) + own - weighted[context, node])
        if context:
            below[context[1:], node] += weighted[context, node]

    def bit(context, node, value):
        found = counts.get((context, node))
        if not found:
            return None
        own = (found[value] + .5) / (sum(found) + 1)
        return own, share.get((context, node), 1.0)

    out = []
    for text in texts:
        score = 0.0
        for context, symbol in steps(text, depth):
            for k in range(8):
                node, value = format(symbol, "08b")[:k], symbol >> (7 - k) & 1
                levels = [x for d in range(depth + 1) if (x := bit(context[depth - d:], node, value))]
                p = .5 if not levels else levels[-1][0]
                for own, own_share in levels[-2::-1]:
                    p = own_share * own + (1 - own_share) * p
                score += math.log10(p)
        out.append(score)
    return out


def base_scores(train, texts):
    tokens = lambda t: [*words(t), None]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for t in texts]
