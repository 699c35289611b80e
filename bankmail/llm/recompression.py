"""Locally consistent names of word runs and pairs, and the anchor of every window of words.

Recompression in rounds: a maximal run of equal symbols becomes one symbol, named by what is repeated
and how often; then symbols are split into left and right ones by a bit of their name, and each left symbol
followed by a right one becomes a symbol named by the two. Names are 64-bit hashes of what they stand
for, so equal stretches of words get equal names in all tasks, with nothing to agree on.

Whether a symbol arises at a place depends on its neighbours of the round before. Each symbol carries the
stretch of words that its rise depends on (its context); inside a window that holds the context, the symbol
arises wherever the window's words stand. So the longest such symbol of a window, the largest hash among
equally long ones, is the same for equal windows in any document: the window's anchor. A window without one,
as in long runs, falls back on its word of largest hash.
"""

from __future__ import annotations

import numpy as np

from bankmail.llm.hashing import U64, mix

ROUNDS = 12
FAR = np.int64(1) << 40


def _paint(best: np.ndarray, first: np.ndarray, last: np.ndarray, value: np.ndarray, most: int) -> None:
    """Raises best[first..last] to at least `value`, for many ranges of at most `most`."""
    length = last - first + 1
    level = np.zeros(len(length), np.int64)
    for k in range(1, most.bit_length()):
        level[length >= 1 << k] = k
    carried = np.zeros_like(best)
    for k in range(most.bit_length() - 1, -1, -1):
        now = carried.copy()
        half = 1 << k  # a block of 2 ** (k + 1) is two of 2 ** k
        np.maximum(now[half:], carried[:-half], out=now[half:])
        own = level == k
        np.maximum.at(now, first[own], value[own])
        np.maximum.at(now, last[own] - (1 << k) + 1, value[own])
        carried = now
    np.maximum(best, carried, out=best)


def _named(span: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Orders symbols by the words they cover (six bits), then by name."""
    return (span.astype(U64) << U64(58)) | (name >> U64(6))


def anchors(words: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window that starts at each word; 0 where the text ends before the window does."""
    n = len(words)
    best = np.zeros(n, U64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[1:][text] - np.arange(n) if n else np.zeros(0, np.int64)
    name, of = words.copy(), text
    first = np.arange(n)
    end = first + 1
    lo, hi = first.copy(), end.copy()
    for k in range(ROUNDS):
        if len(name) < 2:
            break
        name, of, first, end, lo, hi, new = _runs(name, of, first, end, lo, hi, k)
        if len(name) < 2:
            break
        fresh = [(name[new], first[new], end[new], lo[new], hi[new])]
        name, of, first, end, lo, hi, new = _pairs(name, of, first, end, lo, hi, k)
        fresh.append((name[new], first[new], end[new], lo[new], hi[new]))
        for na, f, e, a, b in fresh:
            ok = b - a <= window
            if ok.any():
                from_ = np.maximum(b[ok] - window, bounds[:-1][text[f[ok]]])
                upto = np.minimum(a[ok], bounds[1:][text[f[ok]]] - window)
                fits = from_ <= upto
                _paint(best, from_[fits], upto[fits], _named(e[ok] - f[ok], na[ok])[fits], window)
        if (hi - lo > window).all():  # contexts only grow: nothing fits in any later round
            break
    full = left >= window
    best[~full] = 0
    bare = np.flatnonzero(full & (best == 0))
    if len(bare):  # the word of largest hash, in blocks of the bare windows
        for at in np.array_split(bare, -(-len(bare) // 100_000)):
            best[at] = _named(np.ones(1, np.int64), words[at[:, None] + np.arange(window)].max(1))
    return best


def _runs(name, of, first, end, lo, hi, k):
    """Maximal runs of equal symbols become one; every symbol's context takes in its neighbours, which end its run."""
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(head)
    times = np.diff(np.append(at, len(name)))
    tail = at + times - 1
    before, after = np.maximum(at - 1, 0), np.minimum(tail + 1, len(name) - 1)
    inner_left = (at > 0) & (of[before] == of[at])
    inner_right = (tail < len(name) - 1) & (of[after] == of[at])
    new_lo = np.where(inner_left, lo[before], -FAR)
    new_hi = np.where(inner_right, hi[after], FAR)
    run = times > 1
    out = np.where(run, mix(name[at] * U64(0x9E3779B97F4A7C15) + times.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(2 * k + 1)), name[at])
    return out, of[at], first[at], end[tail], new_lo, new_hi, run


def _pairs(name, of, first, end, lo, hi, k):
    """Each left symbol and a right one after it become one; a symbol that stays has looked at one neighbour."""
    left = (mix(name ^ U64(k * 0xA0761D6478BD642F % 2**64)) >> U64(63)) == 1
    n = len(name)
    joined = np.zeros(n, bool)  # with the next
    joined[:-1] = left[:-1] & ~left[1:] & (of[1:] == of[:-1])
    second = np.zeros(n, bool)
    second[1:] = joined[:-1]
    at = np.flatnonzero(~second)
    pair = joined[at]
    other = np.minimum(at + pair, n - 1)
    after, before = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
    has_after = (at + 1 < n) & (of[after] == of[at])
    has_before = (at > 0) & (of[before] == of[at])
    new_lo, new_hi = lo[at], hi[other]
    alone_left, alone_right = ~pair & left[at], ~pair & ~left[at]
    new_hi = np.where(alone_left, np.where(has_after, np.maximum(new_hi, hi[after]), FAR), new_hi)
    new_lo = np.where(alone_right, np.where(has_before, np.minimum(new_lo, lo[before]), -FAR), new_lo)
    new_lo = np.where(pair, np.minimum(lo[at], lo[other]), new_lo)
    new_hi = np.where(pair, np.maximum(hi[at], hi[other]), new_hi)
    out = np.where(pair, mix(name[at] * U64(0xE7037ED1A0B428DB) ^ mix(name[other] + U64(2 * k + 2))), name[at])
    return out, of[at], first[at], end[other], new_lo, new_hi, pair

