"""Plain versions of what the operators compute, for small tables."""

import itertools
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(rows, n):
    """{place: (shingles, smallest id, None without words)} for rows of (id, text), by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
            group[top(j)] = top(i)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[top(i)] = min(ids.get(top(i), doc_id), doc_id)
    return [(len(sets[i]), ids.get(top(i))) for i in range(len(rows))]


def hits(text, items):
    """(words, hit words, sorted items) of a text, window by window."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = word.findall(lower(item_text))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def repeated(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)})


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated(words))


def buckets(text, n):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(lower(text))]
    pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(word, word[1:])]
    return [signed(h) % n for h in word + pair]
