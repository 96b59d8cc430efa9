"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def lines(docs, least=10):
    """(id, text) -> id: (lines, dropped, sha256 of what is kept)."""
    keys = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            keys[lower(line.strip(" \t\n\x0b\f\r"))].add(i)
    out = {}
    for i, t in docs:
        own = (t or "").split("\n")
        gone = [len(k := lower(x.strip(" \t\n\x0b\f\r"))) >= least and len(keys[k]) > 1 and min(keys[k]) != i for x in own]
        kept = "\n".join(x for x, g in zip(own, gone, strict=True) if not g)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def substrings(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        data = (t or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if s in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        runs = sum(1 for k in range(len(data)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(data), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def base_scores(docs):
    tokens = {i: [*words(t), None] for i, t in docs}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for i, ws in tokens.items()}


def interpolated(docs, parts, rounds=30):
    """id -> log10 probability under plain deleted interpolation; part 0 is not learned from, part 1 is held out for the weights."""
    texts = {i: [*words(t), "\n"] for i, t in docs}
    pairs = {i: list(zip(["\t", *t], t)) for i, t in texts.items()}

    def counts(which):
        own = [i for i in texts if which(parts[i])]
        single, both = Counter(w for i in own for w in texts[i]), Counter(p for i in own for p in pairs[i])
        return single, both, single | Counter({"\t": len(own)}), sum(single.values())

    def parts_of(u, v, model):
        single, both, context, total = model
        c = context[u]
        return int(math.log2(c + 1)), both[u, v] / max(c, 1), single[v] / max(total, 1)

    every, fit, held = counts(lambda p: p > 0), counts(lambda p: p > 1), counts(lambda p: p == 1)
    uniform = 1 / (len(every[0]) + 1)
    seen = defaultdict(list)
    for (u, v), n in held[1].items():
        bucket, pair, one = parts_of(u, v, fit)
        seen[bucket].append((n, (uniform, one, pair)))
    weights = {}
    for bucket, rows in seen.items():
        w, total = [0.2, 0.3, 0.5], sum(n for n, _ in rows)
        for _ in range(rounds):
            share = [0.0] * 3
            for n, p in rows:
                mixed = sum(a * b for a, b in zip(w, p))
                for k in range(3):
                    share[k] += n * w[k] * p[k] / mixed
            w = [max(x / total, 1e-6) for x in share]
            w = [x / sum(w) for x in w]
        weights[bucket] = w
    near = [weights[min(weights, key=lambda k: (abs(k - b), k))] for b in range(64)] if weights else [[0.2, 0.3, 0.5]] * 64

    def score(i):
        out = 0.0
        for u, v in pairs[i]:
            bucket, pair, one = parts_of(u, v, every)
            out += math.log10(sum(a * b for a, b in zip(near[bucket], (uniform, one, pair))))
        return out

    return {i: score(i) for i in texts}, near


def byte_grams(text, most=4):
    data = lower(text).encode()
    return {data[i:i + n] for n in range(1, most + 1) for i in range(len(data) - n + 1)}


def string_kernel(a, b):
    x, y = byte_grams(a), byte_grams(b)
    return len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0


def ftrl(rows, epochs, alpha, beta, l1, l2):
    """Plain follow-the-regularised-leader over (buckets, label) rows; weight of each bucket, the intercept under None."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for found, label in rows:
            value = {i: 1 / math.sqrt(max(1, len(found))) for i in found} | {None: 1.0}
            w = {i: weight(i) for i in value}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * value[i] for i in value)))))
            for i, x in value.items():
                g = (p - label) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs(words, least=12):
    """(start, length, period) of every run, lag by lag."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in best.items())


def collapsed(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_row(doc_id, text):
    words = planted(doc_id, plain_words(text))
    found = runs(words)
    best = min(((-size, s, q) for s, size, q in found), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, found).encode()).hexdigest())


def importance(docs, items, buckets=10_000, least=20, percent=25):
    """doc_id -> n_features, weight, score, rank."""
    def codes(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)

    found = {i: codes(t) for i, t in docs}
    s, t = Counter(c for f, _ in found.values() for c in f), Counter(c for x in items for c in codes(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = {}
    for i, (f, n) in found.items():
        weight = sum(gain[c] for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n)
    able = sorted((i for i, r in rows.items() if r[3] >= least), key=lambda i: (-rows[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(able[:percent * len(able) // 100])}
    return {i: (*r[:3], rank.get(i)) for i, r in rows.items()}


def holds_item(text, items, share=0.8):
    """Does a text hold ``share`` of the distinct shingles (of five words, or of all of a shorter item) of any item?"""
    w = words(text)
    for item in items:
        own = words(item)
        n = min(5, len(own))
        if not n:
            continue
        wanted = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}
        found = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        if 10 * len(wanted & found) >= 10 * share * len(wanted) - 1e-9:
            return True
    return False
