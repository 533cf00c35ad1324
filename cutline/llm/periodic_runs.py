"""Periodic runs of words by string synchronising sets.

A run is a stretch with smallest period p, at least two periods long, that no neighbouring word extends.
Periods below ``DIRECT`` are read off by comparing the text with itself. A dyadic scale j covers the periods
from 2^j to 2^(j+1) with windows of tau = 2^(j-2) words:

* every window has a hash as its name; windows of period tau/3 or less have none. Position i is in the
  synchronising set if the smallest name from i to i + tau is the first or the last of them. Membership depends
  on the 2 tau words from i alone, and every tau positions in a row hold a member or are highly periodic;
* so a run holds a member in its first period, and the same words one period later are a member again. Pairs of
  members with equal 2 tau words and a distance within the scale propose that distance as a period. Equal
  members lie more than tau/3 apart, so a member has a bounded number of partners;
* where both periods of a run are highly periodic themselves, the set is empty. Such a run lies across two touching
  runs of one smaller period; the distances that bring these into phase are proposed as well.

Proposals are extended by comparing words, so a hash proposes and never decides. One document is a row of one
task, and work in it is close to linear; documents of similar length are handled as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cutline.llm.text import chunks, mix

DIRECT = 8
LEAST = 12
BLANKS = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_NAMELESS = np.uint64(2**64 - 1)


def _equal_stretch(t: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, limit: np.ndarray | None = None) -> np.ndarray:
    """How many words from ``x`` and from ``y`` on (``step`` 1) or back (-1) are equal, counted up to ``limit``.
    Ends of ``t`` are separators that equal nothing."""
    found = np.zeros(len(x), np.int64)
    active, width, last = np.arange(len(x)), 16, len(t) - 1
    while len(active):
        going = []
        rows = max(1, (1 << 18) // width)
        for a in range(0, len(active), rows):
            part = active[a: a + rows]
            ahead = step * (found[part, None] + np.arange(width))
            same = t[np.clip(x[part, None] + ahead, 0, last)] == t[np.clip(y[part, None] + ahead, 0, last)]
            whole = same.all(axis=1)
            found[part] += np.where(whole, width, same.argmin(axis=1))
            going.append(part[whole])
        active = np.concatenate(going)
        if limit is not None:
            active = active[found[active] < limit[active]]
        width = min(2 * width, 1 << 16)
    return found if limit is None else np.minimum(found, limit)


def _direct(t: np.ndarray) -> np.ndarray:
    """Runs of periods below ``DIRECT``."""
    found = []
    for p in range(1, min(DIRECT, len(t))):
        edge = np.diff(np.concatenate(([0], (t[:-p] == t[p:]).view(np.int8), [0])))
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        long = end - start >= p
        found.append(np.stack([start[long], end[long] + p, np.full(long.sum(), p)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One row per stretch: of several periods of one stretch all are multiples of the smallest."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _extended(t: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The runs of the proposals "``at`` and ``at + period`` are equal". Proposals of one period that equal words
    connect belong to one run, which is extended once."""
    if not len(at):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    gap = np.diff(at)
    close = np.flatnonzero((period[1:] == period[:-1]) & (gap <= period[1:]))
    linked = np.zeros(len(at), bool)  # with the one before
    linked[close + 1] = _equal_stretch(t, at[close], at[close] + period[close], 1, gap[close]) >= gap[close]
    head = np.flatnonzero(~linked)
    tail = np.append(head[1:], len(at)) - 1
    p = period[head]
    start = at[head] - _equal_stretch(t, at[head] - 1, at[head] + p - 1, -1)
    end = at[tail] + p + _equal_stretch(t, at[tail], at[tail] + p, 1)
    return np.stack([start, end, p], axis=1)[end - start >= 2 * p]


def _synchronised(names: np.ndarray, contexts: np.ndarray, tau: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal members of the synchronising set, 4 to 8 ``tau`` apart."""
    n = len(contexts)
    names = names.copy()
    dense = runs[(3 * runs[:, 2] <= tau) & (runs[:, 1] - runs[:, 0] >= tau)]
    mark = np.zeros(len(names) + 1, np.int32)
    np.add.at(mark, dense[:, 0], 1)
    np.add.at(mark, dense[:, 1] - tau + 1, -1)
    names[np.cumsum(mark[:-1]) > 0] = _NAMELESS
    low, width = names, 1
    while width < tau:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], names[tau: tau + n])
    members = np.flatnonzero((low < _NAMELESS) & ((low == names[:n]) | (low == names[tau: tau + n])))
    order = np.argsort(contexts[members], kind="stable")
    s, c = members[order], contexts[members][order]
    at, distance, k = [], [], 1
    while k < len(s):
        d = s[k:] - s[:-k]
        near = (c[k:] == c[:-k]) & (d < 8 * tau)
        if not near.any():
            break
        near &= d >= 4 * tau
        at.append(s[:-k][near])
        distance.append(d[near])
        k += 1
    nothing = [np.zeros(0, np.int64)]
    return np.concatenate(at or nothing), np.concatenate(distance or nothing)


def _in_phase(t: np.ndarray, tau: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) proposed by touching runs of one period of at most a third of ``tau``."""
    dense = runs[3 * runs[:, 2] <= tau]
    dense = dense[np.lexsort((dense[:, 0], dense[:, 2]))]
    a, b = dense[:-1], dense[1:]
    room = np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0])
    at, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero((a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (room >= 4 * tau)):
        (s1, e1, q), s2 = a[i], b[i, 0]
        turns = np.lib.stride_tricks.sliding_window_view(t[s2: s2 + 2 * q - 1], q)
        turn = np.flatnonzero((turns == t[e1 - q: e1]).all(axis=1))
        if len(turn):
            base = s2 + turn[0] - (e1 - q)
            p = base + q * np.arange(-(base // q), room[i] // q + 1)
            p = p[(p >= 4 * tau) & (p < 8 * tau) & (p <= room[i])]
            at.append(np.maximum(s1, s2 - p))
            distance.append(p)
    return np.concatenate(at), np.concatenate(distance)


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of ``least`` words or more, by text and start.

    ``ids`` holds the numbers of the words of texts laid end to end, ``first`` where each text begins, and the end.
    """
    texts = len(first) - 1
    place = np.arange(len(ids)) + np.repeat(np.arange(1, texts + 1), np.diff(first))
    t = np.full(len(ids) + texts + 1, 0, np.int64)
    t[place] = ids
    border = np.append(first[:-1] + np.arange(texts), len(t) - 1)
    t[border] = -1 - np.arange(texts + 1)  # a separator of its own before each text and at the end
    runs = _smallest_periods(_direct(t))
    names, tau, longest = mix(t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), 1, int(np.diff(first).max(initial=0))
    while longest >= 8 * tau:
        contexts = mix(names[:-tau] * np.uint64(0xD6E8FEB86659FD93) + names[tau:]) if len(names) > tau else names[:0]
        if tau >= DIRECT // 4:
            proposals = _synchronised(names, contexts, tau, runs), _in_phase(t, tau, runs)
            more = _extended(t, *(np.concatenate(x) for x in zip(*proposals)))
            runs = _smallest_periods(np.concatenate([runs, more]))
        names, tau = contexts, 2 * tau
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    text = np.searchsorted(border, runs[:, 0]) - 1
    return np.stack([text, runs[:, 0] - border[text] - 1, runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)


def _collapsed(texts: list[bytes], least: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text, its runs (start, length, period) and its words without repeated periods."""
    words = [text.split() for text in texts]  # bytes split at exactly the blanks of BLANKS
    count = np.array([len(w) for w in words])
    ids = pa.array([w for row in words for w in row], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.append(0, np.cumsum(count))
    runs, out = [np.zeros((0, 3), np.int64)] * len(texts), [b""] * len(texts)
    size = np.frexp(count)[1]
    for level in np.unique(size):  # texts of similar length together: the scales follow the longest
        rows = np.flatnonzero(size == level)
        own = np.append(0, np.cumsum(count[rows]))
        found = runs_of(np.concatenate([ids[first[r]: first[r + 1]] for r in rows]), own, least)
        split = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
        for k, r in enumerate(rows):
            kept = words[r]
            if split[k + 1] > split[k]:
                runs[r] = found[split[k]: split[k + 1], 1:]
                start, length, period = runs[r].T
                mark = np.zeros(count[r] + 1, np.int64)
                np.add.at(mark, start + period, 1)
                np.add.at(mark, start + length, -1)
                kept = [kept[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
            out[r] = b" ".join(kept)
    return runs, out


def periodic_runs(docs: DataFrame, text_column: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words
    that no run holds after its first period, joined by single spaces.

    Words are what blanks separate. A null or empty text has no run and an empty ``collapsed``. Rows are judged one by
    one, so ids may be null or repeated; texts of any length are read whole; columns of ``docs`` named ``runs`` or
    ``collapsed`` are replaced. An empty table gives an empty table. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    out = rows.select("row", F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    of_runs = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            runs, texts = _collapsed(chunk.column("text").cast(pa.binary()).to_pylist(), least)
            flat = np.concatenate(runs)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(of_runs.value_type))
            offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, items)
            yield pa.RecordBatch.from_arrays([chunk.column("row"), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"])

    return rows.mapInArrow(find, out).select("row.*", "runs", "collapsed")


def with_planted_period(docs: DataFrame, key: Column, text_column: str = "text") -> DataFrame:
    """``docs`` where the texts of every tenth ``key`` (a number; null: never) repeat a stretch of their own words:
    with g = key / 10 and n words, the words from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them."""
    words = F.filter(F.split(F.col(text_column), BLANKS), lambda w: w != "")
    chosen = docs.withColumn("__key", key).withColumn("__words", F.when(F.col("__key") % 10 == 0, words))
    at = "int((__key div 10) % size(__words))"
    period = f"int(1 + (size(__words) - {at}) div (3 + (__key div 10) % 8))"
    rest = f"size(__words) - {at}"
    planted = F.expr(
        f"array_join(concat(slice(__words, 1, {at}), slice(flatten(array_repeat(slice(__words, {at} + 1, {period}), "
        f"int(({rest}) div ({period})) + 1)), 1, {rest})), ' ')")
    return chosen.withColumn(text_column, F.when(F.size("__words") > 0, planted).otherwise(F.col(text_column))).drop("__key", "__words")
