"""Fast, exact use of a vocabulary file of the ``tokenizers`` library.

A text is split before every single space that stands between two characters other than white
space. Byte-level splitting always ends a piece there, whatever surrounds it, so the ids of a text
are the ids of its segments in order. Segments repeat a lot; each worker keeps a bounded table of
those it has seen and asks the library only for the rest, in batches.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_INNER = re.compile(r"(?<=[^\W\d_])(?=[^\w\s'])|(?<=\S\n)(?=[^\W\d_])")
_OPEN: dict[tuple[str, int, bool], "SegmentEncoder"] = {}


def segments(text: str) -> list[str]:
    """The text cut at safe boundaries; joined they give the text again."""
    if ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text)):
        parts = _SAFE.split(text)
    else:
        parts = text.split(" ")
    return parts[:1] + [" " + p for p in parts[1:]]


class SegmentEncoder:
    """``keep`` bounds the table of segments; ``with_ids`` false keeps lengths only."""

    def __init__(self, path: str, keep: int, with_ids: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.with_ids = Tokenizer.from_file(path), keep, with_ids
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # one character of a token stands for one byte
            self.bytes_of[i] = len(token)
        self.table: dict[str, int] = {}
        self.lengths, self.starts, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def open(cls, path: str, keep: int = 1_000_000, with_ids: bool = True) -> "SegmentEncoder":
        key = (path, keep, with_ids)
        if key not in _OPEN:
            _OPEN[key] = cls(path, keep, with_ids)
        return _OPEN[key]

    def _trim(self) -> None:
        """Forget segments that were not asked for again since they came in."""
        stay = np.flatnonzero(self.uses >= max(1, np.sort(self.uses)[-(self.keep // 2)]))
        number = np.full(len(self.uses), -1)
        number[stay] = np.arange(len(stay))
        self.table = {s: k for s, k in zip(self.table, number[np.fromiter(self.table.values(), np.int64, len(self.table))].tolist()) if k >= 0}
        if self.with_ids:
            self.ids = gathered(self.ids, self.starts[stay], self.lengths[stay])
        self.lengths = self.lengths[stay]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = self.uses[stay] // 2

    def _add(self, names: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.lengths)
        self.starts = np.concatenate([self.starts, len(self.ids) * self.with_ids + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), np.int64)])
        if self.with_ids:
            self.ids = np.concatenate([self.ids, ids])
        self.table.update(zip(names, range(n, n + len(names))))

    def _ask(self, parts: list[str]) -> None:
        """Encode parts with the library. Those that begin with a space and end with something else
        can stand one after the other in one call; token widths tell them apart again."""
        row, alone = [], []
        for p in parts:
            (row if p[0] == " " and (p[1:].isalpha() or len(p) > 1 and not p[1].isspace() and not p[-1].isspace()) else alone).append(p)
        names, lengths, ids = [], [], []
        encode = lambda x: [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        blocks = [row[a: a + 500] for a in range(0, len(row), 500)]
        for block, got in zip(blocks, encode(["".join(b) for b in blocks])):
            ends = np.cumsum([len(p.encode()) for p in block])
            cuts = np.searchsorted(np.cumsum(self.bytes_of[got]), ends) + 1
            lengths.append(np.diff(cuts, prepend=0))
            names += block
            ids.append(got)
        for a in range(0, len(alone), 1000):
            got = encode(alone[a: a + 1000])
            lengths.append(np.array([len(g) for g in got], np.int64))
            names += alone[a: a + 1000]
            ids += got
        self._add(names, np.concatenate(lengths), np.concatenate(ids))

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Table rows of the segments. Unknown ones are cut further where a letter meets a sign or a
        lone line end meets a letter (also safe), and what is still unknown is encoded."""
        found = np.fromiter(map(self.table.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = dict.fromkeys(parts[i] for i in missing)
            inner = {p: _INNER.split(p) for p in new if not p[1:].isalpha() and "<|" not in p}
            inner = {p: q for p, q in inner.items() if len(q) > 1}
            ask = dict.fromkeys(p for p in new if p not in inner)
            ask |= dict.fromkeys(x for q in inner.values() for x in q if x not in self.table)
            if ask:
                self._ask(list(ask))
            if inner:
                at = np.array([self.table[x] for q in inner.values() for x in q])
                first = np.cumsum([0, *(len(q) for q in inner.values())])[:-1]
                ids = gathered(self.ids, self.starts[at], self.lengths[at]) if self.with_ids else self.ids
                self._add(list(inner), np.add.reduceat(self.lengths[at], first), ids)
            found[missing] = [self.table[parts[i]] for i in missing]
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token count of each text, ids of all texts one after the other; empty unless kept)."""
        if len(self.table) > self.keep:
            self._trim()
        parts: list[str] = []
        sizes = []
        for t in texts:
            own = segments(t) if t else []
            sizes.append(len(own))
            parts += own
        at = self._numbers(parts)
        self.uses += np.bincount(at, minlength=len(self.uses))
        length = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(length)])
        counts = np.diff(total[np.cumsum([0, *sizes])])
        return counts, gathered(self.ids, self.starts[at], length) if self.with_ids else self.ids


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start: start + length]`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
