"""The operators' definitions in plain Python, by brute force."""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from itertools import combinations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, size):
    words = spaced_words(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(ids, links):
    """Smallest id reachable from each."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(ids):
        todo = [] if start in found else [start]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = start
                todo += near[node]
    return found


def near_components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def edits(a, b):
    """Levenshtein distance of two word lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_lines(rows, least=5, near=10):
    """Texts of (doc_id, text) in document order without lines that an earlier line is one edit from."""
    seen, out = [], []
    for _, text in rows:
        lines = []
        for line in text.split("\n"):
            words = spaced_words(line)
            long = len(words) >= near
            gone = len(words) >= least and any(
                words == other or long and len(other) >= near and abs(len(words) - len(other)) <= 1
                and edits(words, other) <= 1 for other in seen
            )
            if len(words) >= least:
                seen.append(words)
            if not gone:
                lines.append(line)
        out.append("\n".join(lines))
    return out


def hits(text, items, span=10):
    """(hit words, item ids) of a text."""
    words, places, found = plain_words(text), set(), set()
    for item_id, item in items:
        tokens = plain_words(item)
        size = min(span, len(tokens))
        windows = {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                places |= set(range(i, i + size))
                found.add(item_id)
    return len(places), found


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match.group())


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}
SECRETS = {
    "assign": (
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m.group(2)) >= 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def matches(text, kinds):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if keep(m)] for k, (p, keep) in kinds.items()}


def targets(sizes, weights=(1.0, 2.0, 3.0), cap=3):
    """Water filling by repetition: cap, share what is left again, until nothing exceeds its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def mined_rules(rows, least, confidence, deviations):
    """{tokens: (bad, covered)} of the rules of rows (tokens, bad), from all subsets of each bad row."""
    rows = [(frozenset(tokens), bad) for tokens, bad in rows if bad is not None and tokens]
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for token in tokens:
            where.setdefault(token, []).append(i)
    items = {min(t for t in where if where[t] == where[token]) for token in where}
    subsets = set()
    for tokens, bad in rows:
        own = sorted(tokens & items)
        if bad:
            subsets |= {frozenset(c) for size in range(1, len(own) + 1) for c in itertools.combinations(own, size)}
    rules = {}
    for subset in subsets:
        held = [bad for tokens, bad in rows if subset <= tokens]
        n, hits, z = len(held), sum(held), deviations**2
        share = hits / n
        bound = (share + z / (2 * n) - deviations * math.sqrt((share * (1 - share) + z / (4 * n)) / n)) / (1 + z / n)
        if hits >= least and bound >= confidence:
            rules[subset] = (hits, n, bound)
    return {
        tuple(sorted(s)): (hits, n) for s, (hits, n, bound) in rules.items()
        if not any(part < s and rules[part][2] >= bound - 1e-12 for part in rules)
    }
