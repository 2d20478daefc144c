"""Plain versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WS = r"[^\x20\x09-\x0D]+"


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


def groups(nodes, linked):
    """node to the smallest node that it can reach."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def op1(rows):
    def good(r):
        return r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])

    ok = sorted({(r[0], tuple(float(x) + 0.0 for x in r[1]), r[2]) for r in rows if good(r)})
    links = Counter()
    edges = []
    for a in ok:
        for b in ok:
            x, y = np.array(a[1]), np.array(b[1])
            if a != b and a[2] == b[2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                edges.append((a[0], b[0]))
    comp = groups({r[0] for r in rows if r[0] is not None}, edges)
    n = [links[r[0], tuple(float(x) + 0.0 for x in r[1]), r[2]] if good(r) else 0 for r in rows]
    return sorted(((r[0], k, comp.get(r[0]), comp.get(r[0], r[0]) == r[0]) for r, k in zip(rows, n)), key=repr)


def op2(rows, n=50):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1) if i is not None else ():
            low[b[s : s + n]] = min(low.get(b[s : s + n], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1) if i is not None else ():
            if low[b[s : s + n]] < i:
                gone[s : s + n] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return sorted(out, key=repr)


def op3(rows):
    fps = []
    for _, t in rows:
        w = re.findall(WS, lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    by = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        if i is not None:
            by[i].append(f)
    ids = sorted(by)
    links = [(a, b) for a in ids for b in ids if a < b and any((x ^ y).bit_count() <= 4 for x in by[a] for y in by[b])]
    comp = groups(ids, links)
    return sorted(((i, f"{f:016x}", comp.get(i)) for (i, _), f in zip(rows, fps)), key=repr)


def op4(rows, least=40, docs=5):
    ws = " \t\n\v\f\r"
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(ws))
            if len(k) >= least and i is not None:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(held.get(lower(x.strip(ws)), ())) >= docs and i < max(held[lower(x.strip(ws))]) for x in lines]
        out.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g).encode())))
    return sorted(out, key=repr)


def op5(rows, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[s : s + n])] |= {str(i)} if i is not None else set()
    out = []
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in windows:
                    hit.update(range(s, s + size))
                    own |= windows[k]
        out.append((i, len(w), len(hit), len(own), sha(",".join(sorted(own)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def op10(rows, n=35):
    """Rows with equal id and text are one document; a null id takes no part."""
    seen = Counter()
    for i, t in {r for r in rows if r[0] is not None}:
        w = re.findall(WS, t or "")
        seen.update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = re.findall(WS, t or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1) if i is not None else ():
            if seen[tuple(w[s : s + n])] > 1:
                gone[s : s + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out, key=repr)
