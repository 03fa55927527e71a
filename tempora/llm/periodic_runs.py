"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run of period q that lasts ``times`` periods holds each of its words ``times`` times.  A word that
is rarer than that within a segment lies in no run of the segment, so it splits it; counts fall in
the parts, which are split again until every word of every segment is frequent enough.  In a segment
that survives, a run of period q holds two neighbouring blocks of q words, aligned to multiples of q,
that are equal; for all q together these are m log m comparisons of prefix hashes.  Lags with such a
pair are compared word by word, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run lasts at least TIMES periods and SHORTEST words.
TIMES, SHORTEST = 4, 6
RUNS = "array<struct<start:long,length:long,period:long>>"


def segments(ids: np.ndarray, times: int, shortest: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches in which every word occurs ``times`` times at least.

    The largest part of a split keeps its counts, less what was cut off, and the others start anew,
    so a word is counted again at most once per halving.
    """
    stack = [(0, ids)]
    while stack:
        base, part = stack.pop()
        part = np.unique(part, return_inverse=True)[1]
        count = np.bincount(part)
        rare = np.flatnonzero(count[part] < times)
        lo, hi, places, first = 0, len(part), None, None
        while hi - lo >= shortest:
            if not len(rare):
                yield base + lo, base + hi
                break
            starts, ends = np.concatenate(([lo], rare + 1)), np.concatenate((rare, [hi]))
            most = int((ends - starts).argmax())
            for i in np.flatnonzero(ends - starts >= shortest):
                if i != most:
                    stack.append((base + int(starts[i]), part[starts[i] : ends[i]]))
            gone, less = np.unique(np.concatenate((part[lo : starts[most]], part[ends[most] : hi])), return_counts=True)
            count[gone] -= less
            lo, hi = int(starts[most]), int(ends[most])
            weak = gone[(count[gone] > 0) & (count[gone] < times)]
            if len(weak) and places is None:
                places, first = np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part))))
            found = [places[first[w] : first[w + 1]] for w in weak]
            rare = np.sort(np.concatenate([at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] for at in found])) if found else weak


def lag_scan(part: np.ndarray, times: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    m = len(part)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(m + 1, 0x9E3779B97F4A7C15, np.uint64))
        value = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * np.uint64(0xFF51AFD7ED558CCD) * power[:m])))
    found = np.empty((0, 3), np.int64)
    for q in range(1, m // times + 1):
        block = np.diff(prefix[::q])
        at = np.flatnonzero(block[:-1] * power[q - 1] == block[1:]) * q
        if not len(at):
            continue
        # What a run of a shorter period that divides q covers has that period.
        inside = found[(q % found[:, 2] == 0) & (found[:, 1] >= 2 * q)]
        for start, length, _ in inside:
            at = at[(at < start) | (at + 2 * q > start + length)]
        if not len(at):
            continue
        ends = np.flatnonzero(np.diff(np.concatenate(([False], part[:-q] == part[q:], [False])).astype(np.int8)))
        start, length = ends[::2], ends[1::2] - ends[::2] + q
        long = length >= max(shortest, times * q)
        new = [(s, n, q) for s, n in zip(start[long], length[long], strict=True) if not ((inside[:, 0] <= s) & (inside[:, 0] + inside[:, 1] >= s + n)).any()]
        if new:
            found = np.concatenate((found, np.array(new, np.int64)))
    return [tuple(map(int, r)) for r in found]


def runs_of(words: list, times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    found = []
    for lo, hi in segments(ids, times, shortest):
        part = np.unique(ids[lo:hi], return_inverse=True)[1]
        found += [(lo + s, n, q) for s, n, q in lag_scan(part, times, shortest)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, text: Column | str = "text", times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and the collapsed text.

    Words are separated by ASCII white space and numbered from 0.  A run is a stretch with least
    period q, at least ``times`` (3 or more) periods and ``shortest`` words long, that no neighbouring
    word extends.  Of every run the first q words stay; kept words are joined by one space.

    ``docs`` needs doc_id and a text; other columns are ignored.  Null, empty and blank texts have no
    words, no runs and an empty collapsed text.  Every row, repeated ones and null doc_ids included,
    gives one row; equal texts give equal results.  Texts of any length are read whole.  An empty
    table gives an empty result.
    """
    if times < 3:
        raise ValueError("a run lasts three periods at least")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for one in batch["text"]:
                words = (one or "").encode("utf-8", "surrogatepass").split()
                runs, kept = runs_of(words, times, shortest), words
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in runs:
                        change[start + period] += 1
                        change[start + length] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept).decode("utf-8", "replace")))
            n, runs, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n, "runs": runs, "collapsed": kept})

    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", (F.col(text) if isinstance(text, str) else text).alias("text"))
    return source.mapInPandas(work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
