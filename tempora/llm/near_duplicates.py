"""Near duplicates of documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

The vertices are distinct shingle sets, so exact copies never form pairs.  Every shingle hash
falls into one of ``bands * rows`` bins and the least of a bin is its MinHash; an empty bin
borrows from the first full one along a fixed random order of the bins (optimal densification).
A bucket is a band's key; each of its members is compared with a hub, on the full sets, and those
outside the hub's component with a further hub, as long as that links any.  Members of one bucket
that are then in different components are compared by size and by parity sketches, which bound
the similarity from above, and on the full sets if these allow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import stage
from tempora.llm.components import roots

BANDS, ROWS, SHINGLE, PERCENT = 40, 8, 5, 85
SEED = 20240501
#: Members of a bucket that are compared as one block.
SLICE = 512


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``size`` words; fewer words make one window, none an empty set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(width):
        out ^= h[j : len(h) - width + 1 + j]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def probe_order(bins: int) -> np.ndarray:
    """For every bin, the order in which it looks for a full one."""
    order = np.tile(np.arange(bins, dtype=np.uint16), (bins, 1))
    return np.random.default_rng(SEED).permuted(order, axis=1)


def signature(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One MinHash per bin of a non-empty sorted set."""
    bins = len(order)
    at = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at[first]], full[at[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        early = full[order[empty, :16]]
        lender = order[empty, early.argmax(axis=1)]
        late = ~early.any(axis=1)
        if late.any():
            lender[late] = order[empty[late], full[order[empty[late]]].argmax(axis=1)]
        out[empty] = out[lender]
    return out


def band_keys(minhashes: np.ndarray, bands: int) -> np.ndarray:
    parts = minhashes.reshape(bands, -1).copy()
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(parts.shape[1]):
        key = (key ^ parts[:, j]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(35)
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, n_shingles, vid (128-bit digest of the set, null if empty), keys (one per band)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = probe_order(bands * rows)
        for batch in batches:
            n, vid, keys = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, size)
                n.append(len(s))
                vid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, order), bands) if len(s) else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "vid": vid, "keys": keys})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, n_shingles long, vid binary, keys array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """vid, shingles of the documents with a non-empty set."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for s in (shingle_set(text, size) for text in batch["text"]) if len(s)]
            yield pd.DataFrame({"vid": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return docs.select("text").mapInPandas(work, "vid binary, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, vertices: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (vid, hub) whose full sets are as similar as asked."""
    ids = pairs.select("vid").union(pairs.select(F.col("hub").alias("vid"))).distinct()
    wanted = vertices.join(ids, "vid").select("doc_id")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = stage(sets_of(texts, size).groupBy("vid").agg(F.first("shingles").alias("shingles")).join(ids, "vid", "left_semi"))
    hubs = sets.select(F.col("vid").alias("hub"), F.col("shingles").alias("others"))
    both = pairs.join(sets, "vid").join(hubs, "hub")
    common = F.size(F.array_intersect("shingles", "others"))
    union = F.size("shingles") + F.size("others") - common
    return both.where(100 * common >= percent * union).select("vid", "hub")


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the set's counts by low hash bits; two sets differ in as many elements as parities at least."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketches_of(docs: DataFrame, size: int) -> DataFrame:
    """vid, n_shingles, sketch of the documents with a non-empty set."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for s in (shingle_set(text, size) for text in batch["text"]) if len(s)]
            yield pd.DataFrame({"vid": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n_shingles": [len(s) for s in sets], "sketch": [sketch(s) for s in sets]})

    return docs.select("text").mapInPandas(work, "vid binary, n_shingles long, sketch binary")


def possible(n: np.ndarray, label: np.ndarray, part: np.ndarray, sketches: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of differing label and part (any part if there is one) that size and sketch do not refute."""
    width = np.array([len(s) for s in sketches])
    one = (part == part[0]).all()
    held = {w: np.stack([np.frombuffer(sketches[i], np.uint64) for i in np.flatnonzero(width == w)]) for w in np.unique(width)}
    for w in held:
        mine, own = np.flatnonzero(width == w), held[w]
        for v in (v for v in held if v >= w):
            theirs, folded = np.flatnonzero(width == v), held[v]
            while folded.shape[1] > own.shape[1]:
                half = folded.shape[1] // 2
                folded = folded[:, :half] ^ folded[:, half:]
            for at, i in enumerate(mine):
                fit = (label[theirs] != label[i]) & (100 * np.minimum(n[theirs], n[i]) >= percent * np.maximum(n[theirs], n[i]))
                fit &= (theirs > i if v == w else True) & (one or part[theirs] != part[i])
                if fit.any():
                    both, apart = n[theirs[fit]] + n[i], np.bitwise_count(folded[fit] ^ own[at]).sum(axis=1).astype(np.int64)
                    for j in theirs[fit][100 * (both - apart) >= percent * (both + apart)]:
                        yield i, j


def unlinked(members: DataFrame, tree: DataFrame, docs: DataFrame, vertices: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (vid, hub) of one bucket and two components that may be similar.

    A bucket is cut into slices, and two slices at a time are compared, so no task has a whole large one.
    """
    m = labelled(members.select("band", "key", "vid"), tree, "vid", "label")
    mixed = m.groupBy("band", "key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("n")).where("l != m")
    rest = stage(m.join(mixed.select("band", "key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), ["band", "key"]))
    ids = rest.select("vid").distinct()
    texts = docs.select("doc_id", "text").join(vertices.join(ids, "vid", "left_semi").select("doc_id"), "doc_id", "left_semi")
    sketches = stage(sketches_of(texts, size).groupBy("vid").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")).join(ids, "vid", "left_semi"))
    cut = rest.withColumn("part", F.pmod(F.xxhash64("vid"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cut = cut.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("slices", "other")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        vid = group["vid"].to_numpy()
        found = list(possible(group["n_shingles"].to_numpy(), pd.factorize(group["label"])[0], group["part"].to_numpy(), list(group["sketch"]), percent))
        return pd.DataFrame([(vid[i], vid[j]) if vid[i] > vid[j] else (vid[j], vid[i]) for i, j in found], columns=["vid", "hub"])

    return cut.join(sketches, "vid").groupBy("band", "key", "low", "high").applyInPandas(work, "vid binary, hub binary").distinct()


def labelled(df: DataFrame, tree: DataFrame, of: str, name: str) -> DataFrame:
    """``df`` with the component of the vertex in column ``of``."""
    known = tree.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return df.join(known, F.col(of) == F.col("__a"), "left").withColumn(name, F.coalesce("__b", of)).drop("__a", "__b")


def near_links(docs: DataFrame, vertices: DataFrame, bands: int, size: int, percent: int) -> DataFrame:
    """Confirmed edges (vid, hub) between distinct sets: any two that share a band are linked, refuted or connected by others."""
    members = vertices.select("vid", "n_shingles", F.posexplode("keys").alias("band", "key"))
    crowds = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(members.join(crowds, ["band", "key"]))
    # The hub is the member that meets the most others in all bands: an original before its copies.
    weight = members.groupBy("vid").agg(F.sum("n").alias("weight"))
    members = members.drop("n").join(weight, "vid")
    done = links = stage(vertices.select("vid", F.col("vid").alias("hub")).limit(0))
    tree, first = links.select(F.col("vid").alias("a"), F.col("hub").alias("b")), None
    while True:
        hubs = members.groupBy("band", "key").agg(F.max(F.struct("weight", "vid", "n_shingles")).alias("hub"))
        stars = members.join(hubs, ["band", "key"]).where(F.col("vid") != F.col("hub.vid"))
        stars = stage(stars.select("band", "key", "vid", "n_shingles", "weight", F.col("hub.vid").alias("hub"), F.col("hub.n_shingles").alias("m")))
        first = first or stars
        pairs = stars.where(100 * F.least("n_shingles", "m") >= percent * F.greatest("n_shingles", "m")).select("vid", "hub").distinct()
        pairs = stage(pairs.join(done, ["vid", "hub"], "left_anti"))
        if pairs.isEmpty():
            break
        found = stage(confirmed(pairs, docs, vertices, size, percent))
        done = done.union(pairs)
        if found.isEmpty():
            break
        links = links.union(found)
        tree = roots(links.select(F.col("vid").alias("a"), F.col("hub").alias("b")))
        # Members outside the hub's component get a hub of their own.
        apart = labelled(labelled(stars, tree, "vid", "label"), tree, "hub", "hub_label").where("label != hub_label")
        members = stage(apart.select("band", "key", "vid", "n_shingles", "weight"))
    # What stars leave open: every bucket's first hub has met all of it, its other members meet here.
    pairs = stage(unlinked(first, tree, docs, vertices, size, percent))
    back = done.select(F.col("vid").alias("hub"), F.col("hub").alias("vid"))
    pairs = stage(pairs.join(done.unionByName(back), ["vid", "hub"], "left_anti"))
    return links if pairs.isEmpty() else links.union(stage(confirmed(pairs, docs, vertices, size, percent)))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are ignored.  Two documents are linked when their
    sets of ``size``-word windows (A-Z lower-cased) share ``percent`` percent of their union.  Null,
    empty and blank texts have an empty set and are linked with nothing.  component_id is the least
    doc_id of the component, and the document that has it is kept.  Repeated rows get one verdict.
    A null doc_id has a null component_id and is kept.  An empty table gives an empty result.
    """
    rows_ = stage(signatures(docs, bands, rows, size))
    vertices = stage(
        rows_.where(F.col("vid").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("vid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    )
    links = near_links(docs, vertices, bands, size, percent)
    tree = roots(links.select(F.col("vid").alias("a"), F.col("hub").alias("b")))
    placed = vertices.join(tree.withColumnsRenamed({"a": "vid", "b": "root"}), "vid", "left").select("vid", "doc_id", F.coalesce("root", "vid").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "root").select("vid", "component_id")
    out = rows_.join(placed, "vid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
