"""Fuzzy duplicate lines of a corpus: MinHash over character shingles, exact Jaccard, union-find.

1. One pass cuts every document into lines and gives each a 128-bit digest and band keys of a
   one-permutation signature over 7-character shingles. 14 bands of 5 find a pair of similarity
   0.8 with probability 0.996, one of 0.9 with 0.999999.
2. Buckets of a band key that hold two different lines give star edges to their smallest line.
   Equal lines have equal digests, so repetitions add no edge.
3. Only lines named by an edge are read again; both sets of an edge are compared in full.
4. A star misses links between its leaves. Buckets whose lines are not all in one component get a second star to their
   best linked line; lines still outside the largest component of a bucket are compared with all its lines,
   in blocks where a bucket is large. So every pair that shares a bucket is linked or in one component.
5. Union-find over the links. Of each component the earliest line (smallest id, then line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cutline.llm.bitmaps import bitmaps, cell_of, cells_for, with_flag
from cutline.llm.graph import components, join_groups
from cutline.llm.near_dedup import _block_links, densified
from cutline.llm.text import chunks, gram_hash, mix
from cutline.session import written

SHINGLE, BANDS, ROWS = 7, 14, 5
SMALL_BUCKET = 64  # lines of a bucket whose pairs are listed
_LINE = "\n"


def normalised_lines(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, row of each, number within its row): lower-cased, blanks trimmed and collapsed."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, _LINE)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    lines = pc.utf8_lower(pc.list_flatten(lists))
    lines = pc.replace_substring_regex(pc.utf8_trim_whitespace(lines), r"\s+", " ")
    row = np.repeat(np.arange(len(sizes)), sizes)
    return lines, row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def character_shingles(lines: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes) of the k-character runs of each line; a shorter line is one run; an empty one none."""
    sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    runs = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(starts - first[:-1], runs) + np.arange(first[-1])
    spread = mix(points + np.uint64(1))
    padded = gram_hash(np.concatenate([spread, np.zeros(k, np.uint64)]), k)
    hashes = padded[at]
    for n in range(1, k):
        own = np.flatnonzero(sizes == n)
        if len(own):
            hashes[first[own]] = gram_hash(np.concatenate([spread, np.zeros(k, np.uint64)]), n)[starts[own]]
    return first, hashes


def line_digest(lines: pa.Array) -> np.ndarray:
    """64-bit order-sensitive hash of each line from all its characters."""
    sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points + (place << np.uint64(24)) + np.uint64(1)))])
    return mix(total[starts + sizes] - total[starts] + sizes.astype(np.uint64))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lines(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            lines, row, number = normalised_lines(chunk.column("text"))
            first, hashes = character_shingles(lines, k)
            keys = np.zeros((len(lines), bands), np.uint64)
            some = np.diff(first) > 0
            for a in range(0, len(lines), 4096):
                part = slice(a, min(a + 4096, len(lines)))
                signature = densified(first[part.start: part.stop + 1] - first[part.start], hashes[first[part.start]: first[part.stop]], bands * rows)
                for i in range(bands):
                    keys[part, i] = mix(gram_hash(signature[:, i * rows: (i + 1) * rows].reshape(-1), rows)[::rows] + np.uint64(i))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), _longs(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id").take(pa.array(row)), pa.array(number, pa.int64()), pa.array(~some), _longs(line_digest(lines)), lists],
                ["id", "line", "blank", "hash", "bands"])

    return docs.mapInArrow(cut, f"id {kind}, line bigint, blank boolean, hash bigint, bands array<bigint>")


def _line_texts(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            lines, _, _ = normalised_lines(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([_longs(line_digest(lines)), lines.cast(pa.string())], ["hash", "said"])

    return docs.select("text").mapInArrow(cut, "hash bigint, said string")


def _similar(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b, x, y) whose texts x and y reach the threshold."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks([batch], "x"):
                (fx, hx), (fy, hy) = (character_shingles(chunk.column(c).cast(pa.large_string()), k) for c in ("x", "y"))
                keep = []
                for i in range(chunk.num_rows):
                    s, t = np.unique(hx[fx[i]: fx[i + 1]]), np.unique(hy[fy[i]: fy[i + 1]])
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([chunk.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def line_components(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(lines: id, line, blank, hash; links of different lines: a, b) of a table (id, text)."""
    lines = written(_lines(docs, k, BANDS, ROWS), "lines")
    rows = lines.select("hash", F.explode("bands").alias("band"))
    shared = written(rows.groupBy("band").agg(F.min("hash").alias("center"), F.max("hash").alias("top"), F.count(F.lit(1)).alias("n"))
                     .where("center < top").drop("top"), "shared")
    # a bitmap of the shared bands rules out nearly all rows before they are shuffled again
    cells = cells_for(shared.count())
    table = written(bitmaps(shared.select(cell_of("band", cells=cells).alias("cell")).distinct()), "band_bits")
    rows = with_flag(rows, table, [cell_of("band", cells=cells)], "may").where("may").drop("may")
    buckets = written(join_groups(rows, shared, "band").select("band", "hash", "center").distinct(), "line_buckets")
    edges = written(buckets.where("hash <> center").select(F.col("hash").alias("a"), F.col("center").alias("b")).distinct(), "line_edges")
    active = written(edges.select(F.col("a").alias("hash")).unionAll(edges.select("b")).distinct(), "active_lines")
    # the documents that show an active line first
    where = lines.where("not blank").select("id", "hash").join(active, "hash").groupBy("hash").agg(F.min("id").alias("id")).select("id").distinct()
    cells = cells_for(active.count())
    table = written(bitmaps(where.select(cell_of("id", cells=cells).alias("cell")).distinct()), "line_bits")
    flagged = with_flag(docs, table, [cell_of("id", cells=cells)], "may").where("may")
    said = written(_line_texts(flagged).join(active, "hash", "left_semi").dropDuplicates(["hash"]), "active_texts")
    links = written(_similar(_with_texts(edges, said), k, percent), "line_links")
    # a bucket of two lines was compared in full
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    mixed = _mixed(join_groups(buckets, written(sizes, "bucket_sizes"), "band"), links)
    degree = links.select(F.col("a").alias("hash")).unionAll(links.select("b")).groupBy("hash").agg(F.count(F.lit(1)).alias("degree"))
    ranked = mixed.join(degree, "hash", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    tops = ranked.groupBy("band").agg(F.max(F.struct("degree", "hash")).alias("top"), F.count(F.lit(1)).alias("n")).select("band", F.col("top.hash").alias("hub"), "n")
    second = join_groups(mixed.select("band", "hash"), written(tops, "hubs"), "band").where("hash <> hub").select(
        F.col("hash").alias("a"), F.col("hub").alias("b")).distinct()
    done = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = written(second.join(done, ["a", "b"], "left_anti"), "line_edges")
    links = written(links.unionByName(_similar(_with_texts(second, said), k, percent)), "line_links")
    return lines, written(links.unionByName(_bucket_links(_mixed(mixed.select("band", "hash", "n"), links), said, k, percent)), "line_links")


def _with_texts(edges: DataFrame, said: DataFrame) -> DataFrame:
    return edges.join(said.select(F.col("hash").alias("a"), F.col("said").alias("x")), "a").join(
        said.select(F.col("hash").alias("b"), F.col("said").alias("y")), "b")


def _mixed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(band, hash, n, component, main) of the buckets that hold more than one component; ``main`` is the largest."""
    found = components(links).withColumnRenamed("node", "hash")
    rows = buckets.select("band", "hash", "n").join(found, "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    rows = written(rows, "bucket_components")
    parts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(
        F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("rows")).where("parts > 1").drop("parts")
    return written(join_groups(rows, written(parts, "mixed"), "band", "rows").select("band", "hash", "n", "component", "main"), "mixed_buckets")


def _bucket_links(mixed: DataFrame, said: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of the lines outside the largest component of a bucket with all its lines of other components."""
    small = mixed.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("band", F.col("hash").alias("b"), F.col("component").alias("component2"))
    pairs = small.where("component <> main").join(other, "band").where("component <> component2").select(
        F.least("hash", "b").alias("a"), F.greatest("hash", "b").alias("b")).distinct()
    found = _similar(_with_texts(written(pairs, "bucket_pairs"), said), k, percent)
    large = mixed.where(F.col("n") > SMALL_BUCKET)
    sets = written(_line_sets(said.join(large.select("hash").distinct(), "hash", "left_semi"), k), "line_sets")
    groups = large.select(F.col("band").alias("group"), F.col("hash").alias("id"), "component", (F.col("component") != F.col("main")).alias("stray"))
    return found.unionByName(_block_links(groups.join(sets, "id"), percent))


def _line_sets(said: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of lines (hash, said)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks([batch], "said"):
                first, h = character_shingles(chunk.column("said").cast(pa.large_string()), k)
                sets = [np.unique(h[a:b]) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([chunk.column("hash"), pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), _longs(np.concatenate(sets)))], ["id", "shingles"])

    return said.select("hash", "said").mapInArrow(cut, "id bigint, shingles array<bigint>")


def repeated_lines(docs: DataFrame, percent: int = 80, k: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_lines, n_kept, dropped) of every row of ``docs``; ``dropped`` lists line numbers from 0, sorted.

    Lines are parted by line feeds, lower-cased, their blanks trimmed and collapsed. Two lines are
    linked when the Jaccard similarity of their ``k``-character shingle sets is ``percent`` hundredths or
    more (a shorter line is one shingle). Of a component the occurrence with the smallest (id, line)
    stays. Blank lines always stay. A null or empty text is one blank line. Rows that repeat an id give
    one result row for all of them; rows of a null id do likewise and come after all others. Other columns are not read; an empty table gives none.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    lines, links = line_components(source, percent, k)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "line")
    first = written(lines.where("not blank").groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "first_places")
    found = components(links).withColumnRenamed("node", "hash")
    linked = first.join(found, "hash")
    winners = linked.groupBy("component").agg(F.min("first").alias("winner"))
    alone = first.join(found, "hash", "left_anti").select("hash", F.col("first").alias("winner"), "n")
    named = written(linked.join(winners, "component").select("hash", "winner", "n").unionByName(alone), "winners")
    judged = join_groups(lines.where("not blank").select("id", "line", "hash"), named, "hash")
    judged = judged.select("id", "line", (F.struct(F.col("id").isNull().alias("last"), "id", "line") != F.col("winner")).alias("drop"))
    everything = judged.unionByName(lines.where("blank").select("id", "line", F.lit(False).alias("drop")))
    return everything.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum((~F.col("drop")).cast("bigint")).alias("n_kept"),
        F.array_sort(F.collect_set(F.when(F.col("drop"), F.col("line")))).alias("dropped")).withColumnRenamed("id", id_column)


def without_repeated_lines(docs: DataFrame, percent: int = 80, k: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut out of the texts; all rows and columns stay. Ids must be unique."""
    found = repeated_lines(docs, percent, k, id_column, text_column).select(F.col(id_column).alias("__id"), F.col("dropped").alias("__dropped"))
    kept = F.filter(F.split(text_column, _LINE), lambda x, i: ~F.array_contains("__dropped", i.cast("bigint")))
    joined = docs.join(found.where("size(__dropped) > 0"), F.col(id_column).eqNullSafe(F.col("__id")), "left")
    text = F.when(F.col("__dropped").isNull(), F.col(text_column)).otherwise(F.array_join(kept, _LINE))
    return joined.withColumn(text_column, text).select(*docs.columns)
