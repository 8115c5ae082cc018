"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width):
    words = WORD.findall(ascii_lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(texts, width, percent):
    """Root (least key) and set size of each key."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {k: (root(k), len(sets[k])) for k in keys}


def removed(texts, length):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    rows = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        rows.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def shared_words(texts, width):
    """Words of each text in ``width`` consecutive ones that another text has too."""
    lists = [WORD.findall(t or "") for t in texts]
    windows = [[tuple(w[p : p + width]) for p in range(len(w) - width + 1)] for w in lists]
    owners = Counter(window for own in windows for window in set(own))
    return [len({p + i for p, window in enumerate(own) if owners[window] > 1 for i in range(width)}) for own in windows]


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def contamination(text, items):
    """(words, hit words, ids of items with an occurring window)."""
    words, hit, found = TERM.findall(ascii_lower(text)), set(), set()
    for item_id, item in items:
        terms = TERM.findall(ascii_lower(item))
        width = min(13, len(terms))
        for s in range(len(terms) - width + 1) if terms else ():
            for p in range(len(words) - width + 1):
                if words[p : p + width] == terms[s : s + width]:
                    hit.update(range(p, p + width))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def luhn(digits):
    return not sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)
