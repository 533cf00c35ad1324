"""Periodic runs against a comparison of every text with itself at every distance."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm.periodic_runs import LEAST, periodic_runs, runs_of, with_planted_period


def all_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    t, best = np.array(words), {}
    for p in range(1, len(words) // 2 + 1):
        edge = np.diff(np.concatenate(([0], (t[:-p] == t[p:]).astype(int), [0])))
        for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)):
            if b - a >= p:
                best.setdefault((int(a), int(b) + p), p)
    return sorted((a, b - a, p) for (a, b), p in best.items() if b - a >= max(least, 2 * p))


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def some_words(rng: random.Random) -> list[int]:
    kind, n = rng.randrange(6), rng.randrange(400)
    if kind == 0:  # few different words
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # stretches of one small period that touch out of phase
        q = rng.randrange(1, 5)
        unit, out = [rng.randrange(2) for _ in range(q)] * 70, []
        for _ in range(rng.randrange(1, 5)):
            out += unit[rng.randrange(q):][: rng.randrange(60)]
        return out * rng.randrange(1, 3)
    if kind == 2:
        return fibonacci(n)
    if kind == 3:  # one long period with changed words
        p = rng.randrange(1, 90)
        unit = [0] * (p - 1) + [1] if rng.random() < 0.5 else [rng.randrange(3) for _ in range(p)]
        side = [rng.randrange(2) for _ in range(rng.randrange(20))]
        out = side + unit * rng.randrange(1, 4) + unit[: rng.randrange(p)] + side
        for _ in range(rng.randrange(3)):
            out[rng.randrange(len(out))] = 5
        return out
    if kind == 4:  # no cube, many squares
        return [bin(i).count("1") % 2 for i in range(n)]
    unit = [rng.randrange(50) for _ in range(30)]
    return [w for _ in range(15) for w in unit[: rng.randrange(30)]]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 8))]
        got = runs_of(np.array([w for t in texts for w in t], dtype=np.int64), np.append(0, np.cumsum([len(t) for t in texts])))
        for i, text in enumerate(texts):
            assert [tuple(r[1:].tolist()) for r in got if r[0] == i] == all_runs(text), text


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    from cutline.llm.queries import QUERIES

    rng = random.Random(3)
    rows = [(None, "a b " * 20), (0, None), (1, ""), (2, " \n\t "), (3, "x " * 30), (3, "x " * 30), (4, "è\xa0b " * 13 + "c d"),
            (5, " ".join(str(rng.randrange(9)) for _ in range(20_000)))]
    rows += [(i, " \n".join("w%d" % w for w in some_words(rng))) for i in range(6, 160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).withColumn("row", F.lit(2))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f " * 4, 7, "t")], "id bigint, body string, runs int, text string")
    row = periodic_runs(docs, "body").first()
    assert row.asDict(recursive=True) == {"id": 1, "body": "a b c d e f " * 4, "text": "t", "collapsed": "a b c d e f",
                                          "runs": [{"start": 0, "length": 24, "period": 6}]}
    assert periodic_runs(docs.limit(0), "body").count() == 0
    assert periodic_runs(docs.select("id", F.lit(None).cast("string").alias("text"))).first()["collapsed"] == ""
    assert with_planted_period(docs, F.lit(None).cast("bigint"), "body").first() == docs.first()
