"""Periodic runs of words, found on a Re-Pair grammar of each portion of documents.

A run is a stretch of words with smallest period q and length at least max(LEAST, TIMES * q) that cannot be
extended. The words of a portion are numbered and compressed by Re-Pair: in rounds, pairs of
neighbouring symbols that occur at least twice become one symbol, at every place where the pair is more frequent than the pairs
that overlap it, until no pair repeats. What is left of a document is joined by halves, so that each
document has one derivation tree.

A run lies whole in some node of that tree and crosses the boundary of the node's two children. Runs are sought once for each
symbol, at one of its places: a run of TIMES periods has two whole periods on one side of the boundary, so
its period is one for which the words beside the boundary repeat at once (a square). Squares are found by equal hashes, the smallest first, and
multiples of a period within its own reach are left out. The reach of a period to both sides is found by bisection on
prefix hashes. Intervals are then translated to all places where the symbol stands, and overlapping ones
of one period are merged, which leaves the maximal ones.

Each portion of about a MiB of text, or one longer document, is worked on alone by its task; nothing is shuffled, and results do not depend on what shares a
portion. Memory grows with the longest document.

Defined cases: null, empty and blank texts have no words and no runs. Repeated rows and null ids are rows of their own. A
very long word is one word. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches
from bankmail.llm.hashing import between, mix, portions, prefixes, words_of

LEAST, TIMES = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of n[k]: its number k, and 0 .. n[k] - 1."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _common(sums: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from i and j on, or before them, of `most` at most."""
    lo, hi = np.zeros(len(i), np.int64), most.copy()
    while (open_ := lo < hi).any():
        k = (lo + hi + 1) // 2
        if back:
            same = between(sums, i - k, i) == between(sums, j - k, j)
        else:
            same = between(sums, i, i + k) == between(sums, j, j + k)
        lo, hi = np.where(open_ & same, k, lo), np.where(open_ & ~same, k - 1, hi)
    return lo


def _squares(ids: np.ndarray, sums: np.ndarray, mid: np.ndarray, most: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(node, q), q up to most[node], for which the q words after (before) the boundary are followed (preceded) by the same."""
    of, q = _counted(most)
    q += 1
    at = mid[of]
    near = ids[at] == ids[at + q] if right else ids[at - 1] == ids[at - 1 - q]
    of, q, at = of[near], q[near], at[near]
    first = at if right else at - 2 * q
    same = between(sums, first, first + q) == between(sums, first + q, first + 2 * q)
    return of[same], q[same]


def crossing(ids: np.ndarray, sums: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(node, first, end, q) of the runs within each node's words [start, end) that cross its boundary `mid`."""
    found = []
    for right in (True, False):
        side = end - mid if right else mid - start
        most = np.where(end - start >= least, np.minimum(side // 2, (end - start) // times), 0)
        of, q = _squares(ids, sums, mid, most, right)
        while len(of):  # the smallest period of each node; what is left after it are no multiples
            head = np.append(True, of[1:] != of[:-1])
            node, p = of[head], q[head]
            anchor = mid[node] if right else mid[node] - 2 * p
            last = anchor + p + _common(sums, anchor, anchor + p, end[node] - anchor - p, False)
            first = anchor - _common(sums, anchor, anchor + p, anchor - start[node], True)
            ok = (last - first >= np.maximum(least, times * p)) & (first < mid[node]) & (last > mid[node])
            found.append((node[ok], first[ok], last[ok], p[ok]))
            group = np.cumsum(head) - 1
            reach = (last - mid[node] if right else mid[node] - first)[group]
            stay = ~head & ((q % p[group] != 0) | (2 * q > reach))
            of, q = of[stay], q[stay]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    rows = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], 1), axis=0)
    return tuple(rows.T)


def _pairs(seq: np.ndarray, of: np.ndarray, live: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round's choice: places of the pairs to be joined, the number of each place's pair, and which pairs may still repeat."""
    key = seq[:-1] * symbols + seq[1:]
    live = live & (of[:-1] == of[1:])
    # overlapping places of one pair, as in a a a, are a streak: every other place counts
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | ~live[1:] | ~live[:-1]
    streak = np.flatnonzero(head)
    length = np.diff(np.append(streak, len(key)))
    group, within = _counted(np.where(live[streak], (length + 1) // 2, 0))
    places = streak[group] + 2 * within
    pairs, which, times = np.unique(key[places], return_inverse=True, return_counts=True)
    rank = np.empty(len(pairs), np.int64)
    rank[np.lexsort((mix(pairs.view(np.uint64)), times))] = np.arange(1, len(pairs) + 1)
    rank[times < 2] = 0
    # a streak is joined where no overlapping pair is more frequent
    of_streak = np.zeros(len(streak), np.int64)
    of_streak[group] = rank[which]
    padded = np.concatenate([[0], of_streak, [0]])
    best = (of_streak > 0) & (of_streak > padded[:-2]) & (of_streak > padded[2:])
    chosen = best[group]
    places, which = places[chosen], which[chosen]
    again = np.bincount(which, minlength=len(pairs))[which] > 1
    return places[again], which[again], np.repeat(of_streak > 0, length)


def runs(hashes: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(first, end, period) of all runs in texts whose words have these hashes; bounds[k] is where text k begins."""
    names, ids = np.unique(hashes, return_inverse=True)
    sums = prefixes(hashes)
    seq, symbols = ids.astype(np.int64), len(names)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.arange(len(seq))
    end = start + 1
    live = np.ones(max(len(seq) - 1, 0), bool)
    found: list[tuple[np.ndarray, ...]] = []

    def join(places: np.ndarray, which: np.ndarray | None, live: np.ndarray) -> np.ndarray:
        """Makes one symbol of each chosen pair, and keeps the runs across its boundary at all its places."""
        nonlocal seq, of, start, end, symbols
        if which is None:
            first, which = np.arange(len(places)), np.arange(len(places))
        else:
            _, first, which = np.unique(which, return_index=True, return_inverse=True)
        node, lo, hi, q = crossing(ids, sums, start[places[first]], start[places[first] + 1], end[places[first] + 1], least, times)
        if len(node):
            base = start[places[first]][node]
            order = np.argsort(which, kind="stable")
            count = np.bincount(which, minlength=len(first))
            row, k = _counted(count[node])
            at = start[places[order[(np.cumsum(count) - count)[node][row] + k]]]
            found.append((at + (lo - base)[row], at + (hi - base)[row], q[row]))
        new = np.zeros(len(seq), bool)
        new[places] = True
        seq[places] = symbols + which
        symbols += len(first)
        end[places] = end[places + 1]
        stay = np.ones(len(seq), bool)
        stay[places + 1] = False
        fresh = new[stay]
        live = np.append(live, False)[stay][:-1] | fresh[:-1] | fresh[1:]
        seq, of, start, end = seq[stay], of[stay], start[stay], end[stay]
        return live

    while len(seq) > 1:
        places, which, repeats = _pairs(seq, of, live, symbols)
        if not len(places):
            break
        live = join(places, which, repeats & live)
    while len(seq) > 1:  # what is left of each text, by halves
        head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        _, within = _counted(np.diff(np.append(head, len(seq))))
        places = np.flatnonzero((within[:-1] % 2 == 0) & (of[:-1] == of[1:]))
        if not len(places):
            break
        join(places, None, np.zeros(len(seq) - 1, bool))
    return _merged(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


def _merged(first: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that share a period's words are one run; by first word, then period."""
    order = np.lexsort((-end, first, q))
    first, end, q = first[order], end[order], q[order]
    change = np.append(True, q[1:] != q[:-1])
    far = np.cumsum(change) * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + far) - far
    head = change.copy()
    head[1:] |= first[1:] > upto[:-1] - q[1:]
    at = np.flatnonzero(head)
    first, end, q = first[at], upto[np.append(at[1:], len(q)) - 1], q[at]
    order = np.lexsort((q, first))
    return first[order], end[order], q[order]


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For each row: id, runs (start, length, period of each in words, by start, then period), and collapsed.

    `collapsed` has the words joined by single spaces, without those after the first period of any run.
    """
    if times < 4:
        raise ValueError("a run of fewer than four periods need not hold a square beside the boundary it crosses")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words = words_of(batch)
            first, end, q = runs(words.hashes, words.starts, least, times)
            rows = np.searchsorted(first, words.starts)
            base = np.repeat(words.starts[:-1], np.diff(rows))
            struct = pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - first), pa.array(q)], fields=list(_RUN.value_type))
            lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), struct)
            change = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(change, first + q, 1)
            np.add.at(change, end, -1)
            dropped = np.cumsum(change) > 0
            texts = []
            for k, t in enumerate(batch.column("text")):
                kept = t.as_py().encode().split()
                if rows[k] < rows[k + 1]:
                    lo = words.starts[k]
                    kept = [kept[i] for i in np.flatnonzero(~dropped[lo : lo + len(kept)])]
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    rows = bounded_batches(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(found, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id)
