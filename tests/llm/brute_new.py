"""Plain Python versions of vector links, source divergence and periodic runs."""

import math
import re
import zlib
from collections import Counter, defaultdict

from brute import lowered, sha


def vector_links(rows, cosine=0.93):
    """(vec_id, n_links, component_id) of rows (vec_id, label, vector) with distinct ids."""
    good = [(i, k, v) for i, k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = {i: math.sqrt(sum(x * x for x in v)) for i, _, v in good}
    partners = defaultdict(set)
    for i, k, v in good:
        for j, m, w in good:
            if i < j and k == m and len(v) == len(w) and sum(x * y for x, y in zip(v, w)) / size[i] / size[j] >= cosine:
                partners[i].add(j)
                partners[j].add(i)
    out = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = partners[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(partners[i]), min(seen)))
    return out


def divergence(rows, least=3, top=200, scale=10**9):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in docs}:
        mine = [(w, s) for w, g, s in docs if g == lang]
        frequency = Counter(t for w, _ in mine for t in set(w))
        kept = {t for t, n in frequency.items() if n >= least}
        counts = {s: Counter() for _, s in mine}
        for w, s in mine:
            counts[s].update(t for t in w if t in kept)
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        excess = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [("pair", o, sum(excess(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [("term", t, excess(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, limit in ((pairs, None), (terms, top)):
                ordered = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit]
                out += [(lang, s, *x, rank) for rank, x in enumerate(ordered, 1)]
    return out


def planted(d, w):
    h, n = 1 if d is None else zlib.crc32(str(d).encode()), len(w)
    if h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs_of(w):
    """All (start, length, period), by the definition."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q):
                part = w[start : start + length]
                if not any(part[k:] == part[: length - k] for k in range(1, q)):
                    out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periods(rows, plant=True):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = planted(d, w) if plant else w
        runs = runs_of(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((d, len(runs), *longest, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
