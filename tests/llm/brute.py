"""Plain Python versions of the operators, for small tables."""

import itertools
import re
import zlib
from array import array
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, again, len(inside), failed


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def shingles(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)]))


def near_duplicates(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets.items(), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def line_dedup(rows, least=10):
    rows = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(UPPER)
    owner = {}
    for i, lines in rows:
        for k in map(key, lines):
            owner[k] = min(i, owner.get(k, i))
    kept = lambda i, x: len(key(x)) < least or owner[key(x)] == i
    return {i: "\n".join(x for x in lines if kept(i, x)) for i, lines in rows}


def cuts(data, gear, shortest, longest, reach, shift):
    """Ends of chunks, byte by byte: local minima of the gear hash, at least `shortest` apart, then the longest length."""
    top = 0xFFFFFFFF
    inner = [b & 0xC0 == 0x80 for b in data]
    h = []
    for i in range(len(data) - 1):
        value = sum(int(gear[data[i - j]]) << (shift * j) for j in range(min(reach, i + 1))) & top
        h.append(top if inner[i + 1] else value)
    ends = []
    for i, x in enumerate(h):
        around = h[max(0, i - shortest) : i] + h[i + 1 : i + 1 + shortest]
        if x != top and x <= min(around, default=top) and (not ends or i + 1 - ends[-1] > shortest):
            ends.append(i + 1)
    out, last = [], 0
    for end in [*ends, len(data)]:
        while end - last > longest:
            last += longest
            while inner[last]:
                last -= 1
            out.append(last)
        out.append(end)
        last = end
    return out


def repeated_spans(rows, cut, least):
    """{(doc, body): [(start, end, chunks, first document)]} of rows (doc, body, text); `cut` gives the ends of chunks."""
    chunks, first = {}, {}
    for doc, body, text in sorted({r for r in rows if r[0] is not None and r[2]}):
        raw, at = text.encode(), 0
        for end in cut(raw):
            start = len(raw[:at].decode())
            chunks.setdefault((doc, body), []).append((start, len(raw[:end].decode()), raw[at:end]))
            first.setdefault(raw[at:end], (doc, body, start))
            at = end
    out = {}
    for key, own in chunks.items():
        runs = []
        for start, end, raw in own:
            if first[raw] < (*key, start):
                if not runs or runs[-1][1] < start:
                    runs.append([start, end, 0, first[raw][0]])
                runs[-1][1:] = end, runs[-1][2] + 1, min(runs[-1][3], first[raw][0])
        if found := [tuple(r) for r in runs if r[1] - r[0] >= least]:
            out[key] = found
    return out


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}
