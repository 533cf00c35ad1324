"""Near duplicates by one-permutation MinHash, banded buckets, star edges and exact confirmation.

1. One pass over the texts gives each document its set size, a 128-bit digest of its set of
   5-word shingles, and band keys. A single permutation throws all shingles into bins; empty
   bins borrow from full ones by optimal densification.
2. Documents of equal sets form a class; only one representative goes on.
3. Buckets of equal band keys with two representatives or more name the candidates. Candidates whose
   shingles are too rarely shared with any other candidate cannot reach the threshold and go.
4. Each bucket gives star edges to its smallest member, then to its best linked one; each
   edge is confirmed on full sets. A star bounds the edges of a bucket by its size.
5. A star may miss links between its leaves. What a group of touching buckets still holds outside its
   largest confirmed component is compared with the whole group, block by block: two blocks of some 64
   sets meet in one task as one matrix product, and only links come out.
6. Distributed union-find over all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutline.llm.bitmaps import bitmaps, cell_of, cells_for, with_flag
from cutline.llm.graph import components, join_groups
from cutline.llm.text import BLANK_WORD, chunks, gram_hash, mix, words_of
from cutline.session import written

BANDS, ROWS = 25, 5
BLOCK_SETS = 64


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the distinct shingles of row i are ``hashes[first[i]: first[i + 1]]``, sorted.

    A row of fewer words than ``k`` has its whole sequence as its only shingle."""
    words = words_of(column, BLANK_WORD)
    at, h = words.grams(k)
    doc = words.doc[at]
    counts = np.diff(words.first)
    for n in range(1, k):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            doc = np.concatenate([doc, rows])
            h = np.concatenate([h, gram_hash(words.hash, n)[words.first[rows]]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(counts) + 1)), h


def densified(first: np.ndarray, hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures (rows x bins) of non-empty sets. An empty bin tries bins in an order
    that depends on its number alone until it meets a full one, so equal sets borrow alike."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    mixed = mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    place = ((mixed >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.full((n, bins), empty)
    np.minimum.at(own.reshape(-1), row * bins + place.astype(np.int64), mixed >> np.uint64(1))
    full = own != empty
    out = own.copy()
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        source = (mix(b.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        good = full[r, source]
        out[r[good], b[good]] = own[r[good], source[good]]
        r, b = r[~good], b[~good]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, d1, d2, bands) of a table (id, text): set size, digest of the set, band keys."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            first, h = shingle_sets(chunk.column("text"), k)
            n = np.diff(first)
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)))]) for c in (0x1234567, 0x89ABCDE)]
            d1, d2 = (t[first[1:]] - t[first[:-1]] for t in total)
            signature = densified(first, h, bands * rows)
            keys = np.stack([gram_hash(signature[:, i * rows: (i + 1) * rows].reshape(-1), rows)[::rows] + np.uint64(i)
                             for i in range(bands)], axis=1) if len(n) else np.zeros((0, bands), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), _signed(mix(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(n, pa.int64()), _signed(d1), _signed(d2), lists], ["id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(sign, f"id {kind}, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            first, h = shingle_sets(chunk.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), _signed(h))], ["id", "shingles"])

    return docs.mapInArrow(cut, f"id {kind}, shingles array<bigint>")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    sizes = edges.where(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    common = F.size(F.array_intersect("x", "y"))
    return sizes.join(left, "a").join(right, "b").where(
        100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _block_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links of the rows marked ``stray`` with all rows of their group (columns group, id, component,
    stray, shingles), other than inside one component."""
    kind = groups.schema["id"].dataType.simpleString()
    size = groups.groupBy("group").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("wide"), F.ceil(F.sum(F.col("stray").cast("int")) / BLOCK_SETS).alias("high"))
    size = written(size.where("high > 0"), "blocks")
    rows = groups.join(size, "group")
    number = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    own = [F.col(c).alias(c) for c in ("id", "component", "shingles")]
    left = rows.where("stray").select(
        F.col("group").alias("g"), number(F.col("high"), 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), *own)
    right = rows.select(
        F.col("group").alias("g"), number(F.col("wide"), 2).alias("j"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), *own)

    def links(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        both = [np.concatenate(list(t["shingles"])) for t in (x, y)]
        _, code = np.unique(np.concatenate(both), return_inverse=True)
        sizes = [np.array([len(s) for s in t["shingles"]]) for t in (x, y)]
        common, width = np.zeros((len(x), len(y)), np.float32), 4096
        owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
        code = [code[: len(both[0])], code[len(both[0]):]]
        for a in range(0, max(c.max() for c in code) + 1, width):
            m = []
            for t in (0, 1):
                inside = (code[t] >= a) & (code[t] < a + width)
                part = np.zeros((len(sizes[t]), width), np.float32)
                part[owner[t][inside], code[t][inside] - a] = 1
                m.append(part)
            common += m[0] @ m[1].T
        union = sizes[0][:, None] + sizes[1][None, :] - common
        apart = x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]
        i, j = np.nonzero((100 * common >= percent * union) & apart)
        return pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j]})

    return left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(links, f"a {kind}, b {kind}")


def _stars(buckets: DataFrame, rank: str) -> DataFrame:
    """Edges of every bucket row (band, id, n, ...) to the bucket's row of the largest ``rank``."""
    center = F.max(F.struct(F.expr(rank).alias("rank"), F.col("id").alias("center"), F.col("n").alias("size"))).alias("top")
    tops = written(buckets.groupBy("band").agg(center, F.count(F.lit(1)).alias("rows")).select(
        "band", "rows", "top.center", F.col("top.size").alias("size")), "centers")
    return join_groups(buckets.select("band", "id", "n"), tops, "band", "rows").select(
        F.col("id").alias("a"), F.col("n").alias("na"), F.col("center").alias("b"), F.col("size").alias("nb"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked when ``100 * intersection >= percent * union`` holds for their sets of
    ``k``-word shingles (words between blanks, A-Z lower-cased). ``component_id`` is the smallest id
    reachable by links. Null, empty and blank texts have an empty set and no link. Repeated rows have
    equal sets and share a component, whatever their number; rows that share an id are one node. Rows with a null id are a document of
    their own each and are not linked. Other columns are not read; an empty table gives none.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    signed = written(signatures(source, k), "signatures")
    classes = written(signed.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).withColumn("key", F.xxhash64("d1", "d2", "n")), "classes")
    reps = signed.where("n > 0 and id is not null").select("id", "n", "bands").join(
        classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    rows = reps.select("id", "n", F.explode("bands").alias("band"))
    rows = written(rows, "bands")
    shared = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared")
    buckets = written(join_groups(rows, shared, "band", "rows").drop("rows"), "buckets")
    links = _links(source, buckets, percent, k)
    found = components(links)
    named = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "d1", "d2", "n", F.coalesce("component", "rep").alias("component"), "rows")
    named = written(named, "named")
    keyed = signed.select("id", "n", F.xxhash64("d1", "d2", "n").alias("key"))
    linked = join_groups(keyed.where("n > 0 and id is not null"), named.select("key", "component", "rows"), "key", "rows")
    out = linked.select("id", "n", "component").unionByName(
        keyed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _links(source: DataFrame, buckets: DataFrame, percent: int, k: int) -> DataFrame:
    """Confirmed links (a, b) between representatives."""
    active = written(buckets.select("id", "n").distinct(), "active")
    cells = cells_for(active.count())
    table = written(bitmaps(active.select(cell_of("id", cells=cells).alias("cell")).distinct()), "active_bits")
    texts = with_flag(source, table, [cell_of("id", cells=cells)], "may").where("may")
    texts = texts.join(active.select("id"), "id", "left_semi").select("id", "text")
    sets = written(_sets(texts, k).dropDuplicates(["id"]), "sets")
    # shingles that no other candidate has can be in no intersection
    owned = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    alone = owned.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    able = written(active.join(alone, "id", "left").where(
        f"100 * (n - coalesce(alone, 0)) >= {percent} * n").select("id"), "able")
    buckets = written(buckets.join(able, "id", "left_semi"), "able_buckets")
    sets = written(sets.join(able, "id", "left_semi"), "able_sets")
    first = written(_stars(buckets, "-id").where("a <> b"), "first_star")
    links = written(_confirmed(first, sets, percent), "links")
    degree = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    hubs = buckets.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    second = _stars(written(hubs, "hubs"), "degree").where("a <> b")
    done = first.select("a", "b").unionAll(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(links.unionByName(_confirmed(second.join(done, ["a", "b"], "left_anti"), sets, percent)), "links")
    # groups of touching buckets, and what they hold outside their largest component
    touching = components(first.select("a", "b"))
    now = components(links)
    member = touching.select(F.col("node").alias("id"), F.col("component").alias("group")).join(
        now.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = written(member, "members")
    largest = member.groupBy("group", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("group").agg(
        F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    strays = member.join(largest.where("parts > 1"), "group").select(
        "group", "id", "component", (F.col("component") != F.col("main")).alias("stray"))
    return links.unionByName(written(_block_links(strays.join(sets, "id"), percent), "block_links"))
