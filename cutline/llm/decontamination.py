"""Benchmark decontamination by winnowed fingerprints.

Of every 9 consecutive 5-word grams (a span of 13 words) the one with the smallest hash is kept as
a fingerprint. A span of 13 words that two texts share therefore leaves at least one common
fingerprint, whatever surrounds it. Shared fingerprints are extended to both sides as far as
the words agree, and a run as long as a window marks its words. Items shorter than a window have no
such guarantee; each is a window of its own and is looked up by its full length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cutline.llm.graph import join_groups
from cutline.llm.text import ALNUM_WORD, Words, chunks, words_of
from cutline.session import written

WINDOW, GRAM = 13, 5
INDEX_BYTES = 16 << 20


def winnowed(at: np.ndarray, hashes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which grams are the rightmost minimum of some ``width`` consecutive grams of their row."""
    n = len(hashes) - width + 1
    keep = np.zeros(len(hashes), bool)
    if n <= 0:
        return keep
    low = hashes[:n].copy()
    best = np.arange(n)
    for j in range(1, width):
        better = hashes[j: j + n] <= low
        low = np.where(better, hashes[j: j + n], low)
        best = np.where(better, np.arange(j, n + j), best)
    keep[best[doc[at[:n]] == doc[at[width - 1:]]]] = True
    return keep


def fingerprints(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of the fingerprints of all rows long enough for a window."""
    at, h = words.grams(gram)
    keep = winnowed(at, h, words.doc, window - gram + 1)
    return at[keep], h[keep]


class Item:
    """Word hashes of a benchmark item and the length of its windows."""

    __slots__ = ("id", "hashes", "window")

    def __init__(self, item_id: object, hashes: np.ndarray, window: int) -> None:
        self.id, self.hashes, self.window = item_id, hashes, min(window, len(hashes))


class Index:
    """Fingerprints of a set of items: hash -> [(item, word position)]; short items by length."""

    def __init__(self, ids: list, column: pa.Array, window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        words = words_of(column, ALNUM_WORD)
        self.items = [Item(i, words.hash[a:b], window) for i, a, b in zip(ids, words.first, words.first[1:])]
        self.found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        at, h = fingerprints(words, window, gram)
        for p, x in zip(at.tolist(), h.tolist()):
            d = int(words.doc[p])
            self.found[0][x].append((d, p - int(words.first[d])))
        for n in sorted({it.window for it in self.items} - {0, window}):
            at, h = words.grams(n)
            for p, x in zip(at.tolist(), h.tolist()):
                d = int(words.doc[p])
                if self.items[d].window == n and len(self.items[d].hashes) == n:
                    self.found[n][x].append((d, 0))
        self.sorted = {n: np.sort(np.fromiter(t, np.uint64, len(t))) for n, t in self.found.items()}

    def spans(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, end word) of every maximal run shared with an item and at least as
        long as one of its windows; word numbers count within the whole chunk."""
        done = defaultdict(list)
        for n, known in self.sorted.items():
            at, h = fingerprints(words, self.window, self.gram) if n == 0 else words.grams(n)
            at, h = (x[np.isin(h, known)] for x in (at, h))
            for p, x in zip(at.tolist(), h.tolist()):
                row = int(words.doc[p])
                for item, q in self.found[n][x]:
                    # on one diagonal a run is extended once
                    if any(a <= p < b for a, b in done[row, item, p - q]):
                        continue
                    a, b = extend(words.hash, int(words.first[row]), int(words.first[row + 1]), p, self.items[item].hashes, q)
                    done[row, item, p - q].append((a, b))
                    if b - a >= self.items[item].window:
                        yield row, item, a, b


def extend(doc: np.ndarray, low: int, high: int, p: int, item: np.ndarray, q: int) -> tuple[int, int]:
    """The maximal run of equal words around doc[p] = item[q]; empty if even these differ."""
    back, ahead = min(p - low, q), min(high - p, len(item) - q)
    right = np.flatnonzero(doc[p: p + ahead] != item[q: q + ahead])
    left = np.flatnonzero(doc[p - back: p] != item[q - back: q])
    return p - (back - 1 - int(left[-1]) if len(left) else back), p + (int(right[0]) if len(right) else ahead)


def _union(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _scan(texts: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, n_words, spans, items) by an index of all items in every task."""
    kind, item_kind = (t.schema["id"].dataType.simpleString() for t in (texts, items))
    known = items.toArrow()  # within INDEX_BYTES, checked by the caller
    id_type = known.column("id").type
    payload = texts.sparkSession.sparkContext.broadcast((known.column("id").to_pylist(), known.column("text").to_pylist()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_texts = payload.value
        index = Index(ids, pa.array(item_texts, pa.large_string()), window, gram)
        for chunk in chunks(batches):
            words = words_of(chunk.column("text"), ALNUM_WORD)
            spans, hits = defaultdict(list), defaultdict(set)
            for row, item, a, b in index.spans(words):
                spans[row].append((a, b))
                hits[row].add(item)
            n = chunk.num_rows
            yield pa.RecordBatch.from_arrays([
                chunk.column("id"), pa.array(np.diff(words.first), pa.int64()), pa.array([_union(spans[i]) for i in range(n)], pa.int64()),
                pa.array([[ids[j] for j in sorted(hits[i])] for i in range(n)], pa.list_(id_type))], ["id", "n_words", "n_hit", "items"])

    return texts.mapInArrow(scan, f"id {kind}, n_words bigint, n_hit bigint, items array<{item_kind}>")


def _joined(texts: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """The same by a shuffled join of fingerprints, for benchmarks of any size.

    Keys of a text are its fingerprints and, for each length of short items, all its grams of that
    length; the (text, item) pairs found meet once more with both texts to be extended. Rows here
    carry a number, since ids may repeat.
    """
    item_kind = items.schema["id"].dataType.simpleString()
    short = sorted(r[0] for r in written(items.select("words"), "item_words").where(
        f"words between 1 and {window - 1}").groupBy("words").count().collect())  # at most window - 1 lengths

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = words_of(chunk.column("text"), ALNUM_WORD)
            rows, hashes = [], []
            for n in [0, *short]:
                at, h = fingerprints(words, window, gram) if n == 0 else words.grams(n)
                rows.append(words.doc[at])
                hashes.append(h ^ np.uint64(n))
            pair = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(hashes)]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("row").take(pa.array(pair[0].astype(np.int64))), pa.array(np.ascontiguousarray(pair[1]).view(np.int64))], ["row", "key"])

    left = written(texts.select("row", "text").mapInArrow(keys, "row bigint, key bigint"), "text_keys")
    right = written(items.select("row", "text").mapInArrow(keys, "row bigint, key bigint").withColumnRenamed("row", "item"), "item_keys")
    per_key = written(left.join(right.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "hit_keys")
    wanted = written(per_key.join(right.groupBy("key").agg(F.collect_set("item").alias("found")), "key"), "found_keys")
    pairs = join_groups(left, wanted, "key").select("row", F.explode("found").alias("item")).distinct()
    met = pairs.join(texts.select("row", "text"), "row").join(
        items.select(F.col("row").alias("item"), F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks([batch]):
                words = words_of(chunk.column("text"), ALNUM_WORD)
                other = chunk.column("item_text").to_pylist()
                out = defaultdict(list)
                for i in range(chunk.num_rows):
                    index = Index([0], pa.array([other[i]], pa.large_string()), window, gram)
                    one = Words(*_one(words, i), ALNUM_WORD)
                    out[i] = [{"a": a, "b": b} for _, _, a, b in index.spans(one)]
                keep = [i for i in range(chunk.num_rows) if out[i]]
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("row").take(take), chunk.column("item_id").take(take),
                     pa.array([out[i] for i in keep], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["row", "item", "spans"])

    hits = met.mapInArrow(confirm, f"row bigint, item {item_kind}, spans array<struct<a:bigint,b:bigint>>")
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))
    per_text = hits.groupBy("row").agg(F.aggregate(ordered, start, step)["n"].alias("n_hit"), F.collect_list("item").alias("items"))
    return texts.select("row", "id", "words").join(per_text, "row", "left").select(
        "id", F.col("words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast(f"array<{item_kind}>")).alias("items"))


def _one(words: Words, row: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = int(words.first[row]), int(words.first[row + 1])
    data = words.data[words.start[a]: words.end[b - 1]] if b > a else words.data[:0]
    return data, np.array([0, len(data)])


def _counted(df: DataFrame) -> DataFrame:
    """Rows with a stable number and their number of words."""
    kind = df.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = words_of(chunk.column("text"), ALNUM_WORD)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), chunk.column("text"), pa.array(np.diff(words.first), pa.int64())], ["id", "text", "words"])

    counted = df.mapInArrow(count, f"id {kind}, text string, words bigint")
    return written(counted.withColumn("row", F.monotonically_increasing_id()), "numbered")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = 20,
                  id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) of every row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or all words of a shorter one. ``n_hit`` counts the
    words inside any occurrence of a window; ``items`` are the distinct items met, sorted; a row
    is contaminated when ``n_hit > 0 and share * n_hit >= n_words``.

    Null texts have no words; items without words have no window; repeated rows and items are
    treated alike; several rows of one item id count as one item; a null item id is no item in ``items`` but
    its words hit. Other columns are not read. With no items nothing is hit; an empty table gives none.

    Items of up to ``index_bytes`` of text in all are sent to every task, and texts are read once without
    a shuffle. Larger benchmarks are met by joining fingerprints. Results are the same.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    items = benchmark.select(F.col(item_column).alias("id"), F.col(text_column).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = _scan(texts, items, window, gram) if total <= index_bytes else _joined(_counted(texts), _counted(items), window, gram)
    return found.select(
        F.col("id").alias(id_column), "n_words", "n_hit", F.array_compact(F.array_sort(F.array_distinct("items"))).alias("items"),
        (F.expr(f"n_hit > 0 and {share} * n_hit >= n_words")).alias("contaminated"))


def items_digest(items: str = "items") -> Column:
    """Lowercase hexadecimal SHA-256 of the item ids, sorted as strings and joined by commas."""
    names = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    return F.sha2(F.array_join(names, ",").cast("binary"), 256)
