"""Plain versions of what the operators compute, and a table of awkward texts."""

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def awkward(n=60, seed=3):
    """Documents with nulls, empty and very long texts, copies, shared lines, odd white space and symbols."""
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "naïve", "x" * 30, "%%%", "a", "b!", "漢字", "İ", "Σ", "1", "22", "it's", "\x01", "\x1c"] + [f"w{k}" for k in range(60)]

    def line(k):
        return " ".join(r.choice(vocabulary) for _ in range(k))

    shared = [line(8) for _ in range(6)] + ["  Short ", "exactly10!", "éééééééééé", "Same LINE here now", "same line here NOW  "]
    texts = [None, "", " ", "\n", "\n\n", "one", "one two", "one two three", "a b   c\n", " 　x", "tab\tsep\x0bvt\x0cff\r\ncr", line(3000), "y" * 5000, ("same words again " * 40).strip()]
    while len(texts) < n:
        texts.append(r.choice(["\n", "\n", " \n"]).join(r.choice(shared) if r.random() < 0.5 else line(r.randint(0, 30)) for _ in range(r.randint(1, 12))))
    texts += [texts[k] for k in (20, 21, 22, 20, 20)]
    base = line(120).split()
    for k in range(5):  # near copies
        x = list(base)
        x[10 * k + 3] = f"changed{k}"
        texts.append(" ".join(x))
    r.shuffle(texts)
    rows = [(k * 3, t, None if k % 7 == 0 else "en", "src0" if k % 3 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows


def crc(i):
    return zlib.crc32(str(i).encode())


def line_dedup(rows):
    """doc_id -> (lines, dropped, kept text)"""

    def key(x):
        return lower(x.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, k):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1)))


def components(rows, k=3, num=85, den=100):
    """doc_id -> (set size, component)"""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
