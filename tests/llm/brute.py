"""Plain single-machine counterparts that the operators are compared with."""

import hashlib
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def components(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, n):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_components(rows, n, part):
    """rows: (doc_id, text), ids may repeat."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    edges = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= part * len(x | y)]
    return components({i for i, _ in sets}, edges)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m[0])) <= 15],
    }
    listed = ",".join(f"{k}:{a}:{b}" for k in found for a, b in found[k])
    return [len(v) for v in found.values()], listed, hashlib.sha256(listed.encode()).hexdigest()


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(listed.encode()).hexdigest()


def targets(sizes):
    """Water level of the mix by resharing; sizes: source -> words, None for the null source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, live, left = {}, set(names), float(sum(sizes.values()))
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in live})
            break
        spent = 0.0
        for s in over:
            target[s] = 3.0 * sizes[s]
            spent += target[s]
            live.discard(s)
        left -= spent
    return target


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def scramble(x):
    """The splitmix64 finaliser on whole numbers."""
    mask = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def window_bins(data, window=64, bins=1000, scale=1024):
    """Entropy bin of every window, counted anew for each; c * log2(c) in steps of 1 / scale, as the operator has it."""
    from collections import Counter
    from math import log2

    part = [round(c * log2(c) * scale) if c else 0 for c in range(window + 1)]
    return [round(bins * (1 - sum(part[c] for c in Counter(data[i:i + window]).values()) / (window * log2(window) * scale)))
            for i in range(len(data) - window + 1)]


def rare_features(data, bins, ranks, window=64, dull=100, popular=16):
    """64-bit hashes of a text's features in order: rarest windows of their surroundings, often enough so."""
    if not data:
        return []
    if len(data) < window:
        return [int.from_bytes(hashlib.sha256(data).digest()[:8], "little")]
    rank = [ranks[b] if b >= dull else len(ranks) + 1 for b in bins]
    picks = [min(range(s, min(s + window, len(rank))), key=lambda t: (rank[t], t)) for s in range(len(rank))]
    places, run = [], 0
    for s, pick in enumerate(picks):
        run = run + 1 if s and picks[s - 1] == pick else 1
        if run == popular and rank[pick] <= len(ranks):
            places.append(pick)
    if not places:
        places = [min(range(len(rank)), key=lambda t: rank[t])]
    out = []
    for p in places:
        h = 0
        for i in range(0, window, 8):
            h = scramble(h ^ int.from_bytes(data[p + i:p + i + 8], "little"))
        if h not in out:
            out.append(h)
    return out


def chain(hashes, bits=2048, count=5, most=160):
    """Bloom filters as sets of set bits."""
    return [{(h >> (11 * i)) & (bits - 1) for h in hashes[at:at + most] for i in range(count)} for at in range(0, len(hashes), most)]


def chain_likeness(a, b, bits=2048):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and sum(map(len, a)) > sum(map(len, b))):
        a, b = b, a
    best = []
    for x in a:
        over = [(len(x & y) - len(x) * len(y) / bits) / max(min(len(x), len(y)) - len(x) * len(y) / bits, 1e-9) for y in b]
        best.append(min(1.0, max(0.0, max(over))))
    return sum(best) / len(best)
