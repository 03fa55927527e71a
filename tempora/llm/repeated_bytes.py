"""Removal of every byte that lies in a string of ``length`` bytes which also starts elsewhere.

A suffix is decided by its first ``length`` bytes, so the work of suffix sorting is done on a
sample of suffixes and on names of longer and longer strings; a suffix whose sampled prefix
occurs once needs no more work.

1. Sample.  Every window of ``length`` bytes takes its sampled suffix: the position in it whose
   ``gram`` bytes hash lowest.  Equal windows sample at the same offset.  Windows next to each
   other mostly share theirs and form a chunk: (anchor, first window, last window).
2. Names.  Chunks are named by their bytes.  An anchor with one occurrence ends all its windows;
   chunks whose name occurs again are repeats throughout.
3. Recursion.  Of anchors with several names, one copy of each name goes on: its windows are dealt
   to cells of ``CELL`` neighbouring offsets, named by the bytes that all of its windows share, and by
   the bytes that any of them has.  The same verdicts hold for cells as for chunks.
4. Remaining suffixes.  Windows of cells that are still open are compared one by one.

Names are 128-bit digests; hot names are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import stage

LENGTH, GRAM, CELL = 400, 100, 16
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Anchors:
    """Finds the sampled positions of texts; keeps tables of powers."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.up = self.down = np.ones(0, np.uint64)

    def gram_hashes(self, raw: bytes) -> np.ndarray:
        n = len(raw)
        if n > len(self.up):
            self.up, self.down = powers(BASE, 2 * n), powers(pow(BASE, -1, 1 << 64), 2 * n)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[np.frombuffer(raw, np.uint8)] * self.up[:n], out=s[1:])
        h = (s[self.gram :] - s[: -self.gram]) * self.down[: n - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def chunks(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first and last window of every chunk, and the anchor's hash; texts have ``length`` bytes at least."""
        h = self.gram_hashes(raw)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        w, n = self.width, len(h)
        blocks = np.full(-(-n // w) * w, MASK, np.uint64)
        blocks[:n] = key
        ahead = np.minimum.accumulate(blocks.reshape(-1, w), axis=1).ravel()
        back = np.minimum.accumulate(blocks.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        return at[first], first, last, h[at[first]].view(np.int64)


def name(raw: memoryview, seed: int = 0) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(raw, seed)
    return (d >> 64) - (1 << 63), (d & MASK) - (1 << 63)


def sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, doc_id, n_bytes, sha256 and the chunks of every document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(length, gram)
        for batch in batches:
            out = []
            for text in batch["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                found = []
                if len(raw) >= length:
                    view = memoryview(raw)
                    p, first, last, a = anchors.chunks(raw)
                    found = [(*row, *name(view[row[1] : row[2] + length])) for row in zip(p.tolist(), first.tolist(), last.tolist(), a.tolist(), strict=True)]
                cols = list(zip(*found, strict=True)) or [()] * 6
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), *map(list, cols)))
            frame = pd.DataFrame(out, columns=["n_bytes", "sha256", "p", "first", "last", "a", "c1", "c2"])
            frame.insert(0, "key", batch["key"])
            frame.insert(1, "doc_id", batch["doc_id"])
            yield frame

    return docs.mapInPandas(work, f"key binary, doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, sha256 string, p array<int>, first array<int>, last array<int>, a array<long>, c1 array<long>, c2 array<long>")


def cells(texts: DataFrame, length: int, cell: int) -> DataFrame:
    """Cells of the chunks listed with a text; offsets are counted back from the anchor."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, found in zip(batch["key"], batch["text"], batch["chunks"], strict=True):
                view, out = memoryview(text.encode("utf-8", "surrogatepass")), []
                for c in found:
                    p, low, high = c["p"], c["p"] - c["last"], c["p"] - c["first"]
                    for t in range(low // cell, high // cell + 1):
                        a, b = max(low, t * cell), min(high, t * cell + cell - 1)
                        inner = xxhash.xxh3_64_intdigest(view[p - t * cell : p - t * cell - cell + 1 + length], t) - (1 << 63)
                        out.append((key, p, a, b, c["many"], inner, *name(view[p - b : p - a + length], a * (1 << 20) + b)))
                yield pd.DataFrame(out, columns=["key", "p", "a", "b", "many", "inner", "o1", "o2"])

    return texts.mapInPandas(work, "key binary, p int, a int, b int, many boolean, inner long, o1 long, o2 long")


def windows(texts: DataFrame, length: int) -> DataFrame:
    """Digests of the single windows of the cells listed with a text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, found in zip(batch["key"], batch["text"], batch["cells"], strict=True):
                view, out = memoryview(text.encode("utf-8", "surrogatepass")), []
                for c in found:
                    for start in range(c["p"] - c["b"], c["p"] - c["a"] + 1):
                        out.append((key, start, c["many"], *name(view[start : start + length])))
                yield pd.DataFrame(out, columns=["key", "start", "many", "f1", "f2"])

    return texts.mapInPandas(work, "key binary, start int, many boolean, f1 long, f2 long")


def cut(texts: DataFrame, length: int) -> DataFrame:
    """What is left of texts once the windows in ``spans`` (first and last start) are taken out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, spans in zip(batch["key"], batch["text"], batch["spans"], strict=True):
                raw, left, at, merged = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, []
                for first, last in sorted((s["first"], s["last"] + length) for s in spans):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(last, merged[-1][1])
                    else:
                        merged.append([first, last])
                for first, last in merged:
                    left.update(raw[at:first])
                    at = last
                left.update(raw[at:])
                out.append((key, sum(b - a for a, b in merged), len(merged), left.hexdigest(), merged))
            yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept_sha256", "removed"])

    return texts.mapInPandas(work, "key binary, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """Repeated bytes of every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed ([from, to) pairs).

    ``docs`` needs doc_id and text; other columns are ignored.  Texts count as UTF-8, null as empty;
    matches never cross rows.  Texts shorter than ``length`` lose nothing.  Rows that repeat doc_id and
    text are repeats of each other and lose all bytes from ``length`` on.  An empty table gives an
    empty result.
    """
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))
    keyed = docs.select(key.alias("key"), "doc_id", "text")
    rows = stage(sampled(keyed, length, gram))
    chunk = rows.select("key", F.explode(F.arrays_zip("p", "first", "last", "a", "c1", "c2")).alias("c")).select("key", "c.*")

    names = chunk.groupBy("a", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "p", "first", "last")).alias("at"))
    names = stage(names)
    open_anchors = names.groupBy("a").agg(F.count(F.lit(1)).alias("n_names"))
    names = stage(names.join(open_anchors.where("n_names > 1"), "a", "left").where("n > 1 or n_names > 1").drop("a"))
    repeats = chunk.join(names.where("n > 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("key", "first", "last")
    repeats = stage(repeats)
    going = names.where("n_names > 1").select("at.*", (F.col("n") > 1).alias("many"))
    going = stage(going.groupBy("key").agg(F.collect_list(F.struct("p", "first", "last", "many")).alias("chunks")))
    touched = repeats.select("key").union(going.select("key")).distinct()
    # The joins with texts are merge joins at every size: what they are joined with grows with the input.
    texts = stage(keyed.select("key", "text").join(touched.hint("merge"), "key", "left_semi").dropDuplicates(["key"]))

    cell_rows = stage(cells(texts.join(going.hint("merge"), "key"), length, cell))
    kinds = cell_rows.groupBy("inner", "o1", "o2").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min(F.struct("key", "p", "a", "b")).alias("at"))
    kinds = stage(kinds)
    open_cells = kinds.groupBy("inner").agg(F.count(F.lit(1)).alias("n_names")).where("n_names > 1")
    same_cells = cell_rows.where(~F.col("many")).join(kinds.where("n > 1").select("inner", "o1", "o2"), ["inner", "o1", "o2"], "left_semi")
    same_cells = stage(same_cells.select("key", (F.col("p") - F.col("b")).alias("first"), (F.col("p") - F.col("a")).alias("last")))
    rest = kinds.join(open_cells, "inner", "left_semi").select("at.*", (F.col("n") > 1).alias("many"))
    rest = rest.groupBy("key").agg(F.collect_list(F.struct("p", "a", "b", "many")).alias("cells"))
    single = stage(windows(texts.join(rest.hint("merge"), "key"), length))
    found = single.groupBy("f1", "f2").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").select("f1", "f2")
    same_windows = single.where(~F.col("many")).join(found, ["f1", "f2"], "left_semi").select("key", F.col("start").alias("first"), F.col("start").alias("last"))

    spans = repeats.union(same_cells).union(same_windows).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    done = cut(texts.join(spans.hint("merge"), "key"), length)
    out = rows.select("key", "doc_id", "n_bytes", "sha256").join(done, "key", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<array<bigint>>")).alias("removed"),
    )
