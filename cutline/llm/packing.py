"""Hierarchical packing of documents into sequences of several lengths.

Every task packs the documents of its own partition as they stream by; nothing is shuffled and
no document is held beyond a bounded pool. A document gives full windows of the longest tier and
a rest; the rest is routed to the shortest tier that takes it. Windows of a tier start from its
own pieces, their gaps are filled with whole pieces of shorter tiers, best fit first, and what
gap remains is closed by cutting a waiting piece. At the end of a partition the waiting pieces fill
windows of ever shorter powers of two. Each sequence is therefore exactly as long as a power of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cutline.llm.text import chunks

_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


class Piece:
    """A run of tokens of one document that still waits for a place."""

    __slots__ = ("doc", "start", "ids", "tokens")

    def __init__(self, doc: object, start: int, ids: np.ndarray, tokens: int) -> None:
        self.doc, self.start, self.ids, self.tokens = doc, start, ids, tokens

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:n], self.tokens), Piece(self.doc, self.start + n, self.ids[n:], self.tokens)


class Packer:
    """Packs the documents of one partition. ``pool`` bounds the waiting pieces of a tier."""

    def __init__(self, tiers: tuple[int, ...], pool: int, group_tokens: int, part: int) -> None:
        self.tiers, self.pool, self.group_tokens, self.base = sorted(tiers), pool, group_tokens, part << 33
        self.groups: dict[int, tuple[int, int]] = {}
        self.made = 0
        self.waiting: dict[int, list[tuple[int, int, Piece]]] = {t: [] for t in self.tiers}
        self.count, self.order, self.rows = 0, 0, []

    def add(self, doc: object, ids: np.ndarray) -> None:
        longest = self.tiers[-1]
        rest = Piece(doc, 0, ids, len(ids))
        while len(rest.ids) >= longest:
            window, rest = rest.cut(longest)
            self._write(longest, [window])
        self._wait(rest)
        for tier in self.tiers:
            if len(self.waiting[tier]) > self.pool:
                self._window(tier)

    def _wait(self, piece: Piece) -> None:
        n = len(piece.ids)
        if n:
            self.order += 1
            insort(self.waiting[next(t for t in self.tiers if n <= t)], (n, self.order, piece))

    def _write(self, tier: int, pieces: list[Piece]) -> None:
        group, held = self.groups.get(tier, (0, 0))
        if held == 0:
            group, self.made = self.made, self.made + 1
        full = held + tier >= self.group_tokens
        self.groups[tier] = (group, 0 if full else held + tier)
        offset = 0
        for p in pieces:
            ids = p.ids.astype("<u4")
            self.rows.append((p.doc, p.start, len(ids), zlib.crc32(ids.tobytes()), p.tokens, self.base + self.count, offset, tier, self.base + group))
            offset += len(ids)
        self.count += 1

    def _best(self, below: int, gap: int) -> Piece | None:
        """The longest waiting piece that fits the gap, from the tiers up to ``below``."""
        for tier in reversed([t for t in self.tiers if t <= below]):
            pool = self.waiting[tier]
            k = bisect_right(pool, gap, key=lambda x: x[0])
            if k:
                return pool.pop(k - 1)[2]
        return None

    def _window(self, size: int, tier: int | None = None) -> None:
        """Write one window of ``size`` tokens, started with the longest piece of the tier."""
        tier = tier or size
        gap, pieces = size, []
        while gap:
            piece = self._best(tier, gap)
            if piece is None:  # all that wait are longer than the gap: cut the shortest
                pool = next(self.waiting[t] for t in self.tiers if self.waiting[t])
                piece, rest = pool.pop(0)[2].cut(gap)
                self._wait(rest)
            pieces.append(piece)
            gap -= len(piece.ids)
        self._write(size, pieces)

    def finish(self) -> None:
        left = sum(n for pool in self.waiting.values() for n, _, _ in pool)
        size = 1 << (self.tiers[-1].bit_length() - 1)
        while left:
            while left < size:
                size //= 2
            self._window(size, self.tiers[-1])
            left -= size


def packed_pieces(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (1024, 512, 256, 128), end_id: int = 0, pool: int = 64,
                  group_tokens: int = 32_768, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group).

    A document is its ids, then ``end_id``. ``tiers`` must be powers of two; each sequence is exactly
    as long as its ``tier`` says (the last ones of a partition may be shorter powers of two), so none needs
    padding. ``step_group`` gathers sequences of one tier to the same number of tokens
    (``group_tokens``), so that steps cost the same. Null and empty
    texts are documents of one token; repeated rows are packed as often as they come; ids may be null;
    other columns are not carried. An empty table gives an empty table.

    Numbers carry the partition in their upper bits, so no partition waits for another: a partition has
    one incomplete step group for each tier.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    kind = docs.schema[id_column].dataType.simpleString()
    types = [pa.int64()] * 6 + [pa.int32(), pa.int64()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cutline.llm.encoding import SegmentEncoder

        encoder, packer, id_type = SegmentEncoder.open(tokenizer), Packer(tiers, pool, group_tokens, TaskContext.get().partitionId()), None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["id", *_COLUMNS])

        for chunk in chunks(batches, size=1 << 21):
            ids_of, id_type = chunk.column("id").to_pylist(), chunk.column("id").type
            counts, ids = encoder.encode(pc.fill_null(chunk.column("text"), "").to_pylist())
            for doc, n, end in zip(ids_of, counts.tolist(), np.cumsum(counts).tolist()):
                packer.add(doc, np.append(ids[end - n: end], np.uint32(end_id)))
            if packer.rows:
                yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    pieces = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        pack, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
        "tier int, step_group bigint")
    return pieces.select(F.col("id").alias(id_column), *_COLUMNS)
