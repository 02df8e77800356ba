"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rlz(docs, size=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for k in range(len(w) - size + 1):
            if d is not None:
                first[tuple(w[k : k + size])] = min(first.get(tuple(w[k : k + size]), d), d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if d is not None and first[tuple(w[k : k + size])] < d:
                gone.update(range(k, k + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeats(docs, size=200):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[k : k + size] for _, b in data for k in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", gone)), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def components(docs, size=4, percent=80):
    """(doc_id, set size, least id reachable) of each document; ids are distinct."""
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append((d, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    label = {d: d for d, _ in sets}
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in range(len(sets)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return [(d, len(x), label[d]) for d, x in sets]
