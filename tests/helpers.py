"""Brute-force reference computations in plain Python (small inputs only)."""

import math

EPS = 0.0001


def usable(xs):
    return [float(x) for x in xs if x is not None and not math.isnan(float(x)) and not math.isinf(float(x))]


def sturges(n):
    """ceil(log2 n) + 1 by counting doublings (1 bin for n <= 1)."""
    k = 0
    while (1 << k) < n:
        k += 1
    return k + 1


def psi_numeric(ref, cur):
    r, c = usable(ref), usable(cur)
    if not r or not c:
        return None, len(set())
    pooled = r + c
    lo, hi, k = min(pooled), max(pooled), sturges(len(pooled))

    def b(v):
        if hi == lo:
            return 0
        return min(int(math.floor((v - lo) / ((hi - lo) / k))), k - 1)

    return _psi([b(v) for v in r], [b(v) for v in c])


def psi_categorical(ref, cur):
    r = [x for x in ref if x is not None]
    c = [x for x in cur if x is not None]
    if not r or not c:
        return None, 0
    return _psi(r, c)


def _psi(rb, cb):
    keys = set(rb) | set(cb)
    nr, nc = len(rb), len(cb)
    total = 0.0
    for key in keys:
        pr = rb.count(key) / nr or EPS
        pc = cb.count(key) / nc or EPS
        total += (pc - pr) * math.log(pc / pr)
    return round(total, 8), len(keys)
