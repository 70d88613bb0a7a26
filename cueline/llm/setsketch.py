"""SetSketch registers: exponentially spaced, truncated minima of hashed elements.

An element draws one value from each of ``M`` slices of the exponential
distribution that hold the same probability, in rising order, and gives them to
the registers in an order of its own. A register keeps the smallest value ``x``
that it is given, as ``floor(1 - log_b(x))``. Two sketches merge by taking the
larger register of each pair, and a register of two sets is equal about as often
as the sets' Jaccard similarity, as the base ``b`` is close to 1.
"""

from __future__ import annotations

import numpy as np

from cueline.llm.hashing import mix

#: Registers, base and rate. A register fits 16 bits for sets of up to about 10**26 elements.
M, BASE, RATE = 128, 1.001, 20.0
#: Registers to a band: four of 16 bits are one 64-bit key. Of sets of similarity 0.75 all 32 bands
#: differ once in (1 - 0.75**4)**32, about 5 in a million pairs.
ROWS = 4
BANDS = M // ROWS

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _minima(elements: np.ndarray, owner: np.ndarray, docs: int, reach: np.ndarray) -> np.ndarray:
    """The smallest slice position (slice number plus place in it) at each register of each document.

    Positions of ``reach[document]`` and more are left out.
    """
    out = np.full(docs * M, np.inf)
    seed = mix(elements)
    # Four odd or free numbers of 7 bits: an element's own order of the registers.
    own = [((seed >> np.uint64(k)) & np.uint64(M - 1)).astype(np.int32) for k in (0, 7, 14, 21)]
    live = np.arange(len(elements))
    limit = reach[owner]
    for j in range(M):
        live = live[limit[live] > j]
        if not len(live):
            break
        place = j + (mix(seed[live] + np.uint64((j + 1) * int(_STEP) % (1 << 64))) >> np.uint64(11)) * 2.0**-53
        hit = place < limit[live]
        at = live[hit]
        np.minimum.at(out, owner[at] * M + _register(j, *(x[at] for x in own)), place[hit])
    return out.reshape(docs, M)


def _register(j: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The register that gets an element's ``j``-th value: a bijection of the 7 bits of ``j``.

    Each step is one; the shifts keep it from being linear, under which the bands of very small sets depend on each other.
    """
    r = (a + (2 * b + 1) * j) & (M - 1)
    r ^= r >> 4
    r = (r * (2 * c + 1) + d) & (M - 1)
    return r ^ (r >> 3)


def registers(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (documents x M, 16 bits) of sets of 64-bit elements; an empty set has zeros."""
    sizes = np.diff(bounds)
    docs = len(sizes)
    owner = np.repeat(np.arange(docs), sizes)
    # Beyond this position an element hardly ever is a minimum; the few documents with a register left open are done in full.
    reach = M * -np.expm1(-(np.log(M) + 8) / np.maximum(sizes, 1))
    least = _minima(elements, owner, docs, reach)
    open_ = np.flatnonzero(np.isinf(least).any(axis=1) & (sizes > 0))
    for doc in open_:
        own = elements[bounds[doc] : bounds[doc + 1]]
        least[doc] = _minima(own, np.zeros(len(own), np.int64), 1, np.full(1, float(M)))[0]
    out = np.zeros((docs, M), np.uint16)
    full = sizes > 0
    x = -np.log1p(-least[full] / M) / RATE
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 1, 65535)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key (as int64) for each band of each sketch."""
    raw = np.ascontiguousarray(regs).view(np.uint64)
    band = mix((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _STEP)
    return mix(raw ^ band).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely similarity of pairs of sketches (rows), given the sets' sizes.

    The numbers of registers at which either side is larger, or neither, have the
    probabilities p(u - vJ), p(v - uJ) and the rest, where u and v are the sizes' shares
    and p(x) = -log_b(1 - x (b - 1) / b). The log-likelihood is concave in J; its
    derivative is bisected.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = M - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    shrink = (BASE - 1) / BASE
    scale = 1 / np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * shrink) * scale

    def slope(x: np.ndarray) -> np.ndarray:
        return shrink * scale / (1 - x * shrink)

    low = np.zeros(len(u))
    high = np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        px, py, dx, dy = p(x), p(y), -v * slope(x), -u * slope(y)
        rises = more * dx / px + less * dy / py - same * (dx + dy) / np.maximum(1 - px - py, 1e-12) > 0
        low, high = np.where(rises, j, low), np.where(rises, high, j)
    return (low + high) / 2
