"""Plain second writings of the operators, for small inputs."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def spans_of(mask):
    return sum(1 for p in range(len(mask)) if mask[p] and (p == 0 or not mask[p - 1]))


def contamination(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            if n and item is not None:
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    found |= got
                    hit[i : i + n] = [1] * n
        out.append((doc, len(w), sum(hit), len(found), sha(",".join(sorted(found)).encode()), sum(hit) > 0))
    return out


def suffix_spans(docs):
    key = lambda d: float("inf") if d is None else d
    first = {}
    for doc, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, key(doc)), key(doc))
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(doc):
                m[p : p + 50] = b"\1" * 50
        out.append((doc, len(b), sum(m), spans_of(m), sha(bytes(x for x, g in zip(b, m) if not g))))
    return out


def units(docs):
    key = lambda d: (d[0] is None, d[0] or 0, d[1] or "")
    seen, out = set(), []
    for doc, text in sorted(docs, key=key):
        b = (text or "").encode()
        m, at, every, said = bytearray(len(b)), 0, [], []
        for line in b.split(b"\n"):
            ws = [(x.start() + at, x.end() + at) for x in re.finditer(rb"[^\x20\x09-\x0D]+", line)]
            at += len(line) + 1
            groups, now = [(1, ws)] if ws else [], []
            for w in ws:
                now.append(w)
                if b[w[1] - 1] in b".!?":
                    groups.append((2, now))
                    now = []
            groups += [(2, now)] if now else []
            every += groups
            said += [g for kind, g in groups if kind == 2]
        every += [(3, x + y) for x, y in zip(said, said[1:]) if min(len(x), len(y)) < 6]
        # by place, as the same unit may stand twice in a text
        for kind, g in sorted(every, key=lambda u: (u[0], u[1][0])):
            if len(g) < {1: 5, 2: 6, 3: 6}[kind]:
                continue
            k = kind, b" ".join(b[x:y] for x, y in g).lower()
            if k in seen:
                m[g[0][0] : g[-1][1]] = b"\1" * (g[-1][1] - g[0][0])
            seen.add(k)
        out.append((doc, len(b), sum(m), spans_of(m), sha(bytes(x for x, g in zip(b, m) if not g))))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs, least=80):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= least * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


def vector_codes(rows):
    """rows: (vec_id, vector, label), all of one length. In Python's integers and fractions."""
    from fractions import Fraction
    from math import floor

    good = [(i, [floor(4096 * Fraction(c)) for c in v], x) for i, v, x in rows if v and all(c is not None and c == c and abs(c) != float("inf") for c in v)]
    if not good:
        return []
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(good[0][1])
    part = lambda v, j: v[j * d // 8 : (j + 1) * d // 8]
    books = [[part(v, j) for _, v, _ in good[:16]] for j in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[j])), key=lambda e: (far(part(v, j), books[j][e]), e)) for j in range(8)] for _, v, _ in good]

    for _ in range(6):
        codes = assign()
        for j in range(8):
            for e in range(len(books[j])):
                mine = [part(v, j) for (_, v, _), c in zip(good, codes) if c[j] == e]
                if mine:
                    books[j][e] = [sum(c) // len(mine) for c in zip(*mine)]
    codes = assign()
    errors = [sum(far(part(v, j), books[j][c[j]]) for j in range(8)) for (_, v, _), c in zip(good, codes)]
    held = lambda n: min(n, (1 << 63) - 1)
    name = sha(",".join(str(c) for b in books for e in b for c in e).encode())
    total = {}
    for (_, _, x), n in zip(good, errors):
        total[x] = total.get(x, 0) + held(n)
    return [(i, "".join(f"{e:02x}" for e in c), held(n), held(total[x]), name) for (i, _, x), c, n in zip(good, codes, errors)]
