"""Dense families of templated lines against brute force over the same buckets."""

from __future__ import annotations

import random

import pytest

from cutline.llm import line_dedup


def family(rng: random.Random, n: int) -> list[str]:
    """Lines of one template with several free fields: most pairs are below 0.8, some are above."""
    word = lambda size: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    fields = [[word(7) for _ in range(9)] for _ in range(3)]
    lines = set()
    while len(lines) < n:
        a, b, c = (rng.choice(f) for f in fields)
        lines.add(f"the daily price list of the market shows item {a} at the usual counter in the old hall near the river with code {b} and the number {c} for today")
    return sorted(lines)


def linked(a: str, b: str) -> bool:
    s, t = ({x[i: i + 7] for i in range(len(x) - 6)} for x in (a, b))
    return 100 * len(s & t) >= 80 * len(s | t)


def roots(nodes: list, edges: list) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("small", [64, 2])
def test_dense_families_by_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", small)
    rng = random.Random(2)
    lines = [x for _ in range(6) for x in family(rng, 40)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id bigint, text string")
    # pairs of at least 0.8 that share a bucket
    table, links = line_dedup.line_components(docs, 80, 7)
    rows = {r.id: (r.hash, set(r.bands)) for r in table.collect()}
    edges = [(rows[i][0], rows[j][0]) for i in rows for j in range(i) if rows[i][1] & rows[j][1] and linked(lines[i], lines[j])]
    got = roots([h for h, _ in rows.values()], [(r.a, r.b) for r in links.collect()])
    wanted = roots([h for h, _ in rows.values()], edges)
    same = lambda r: {frozenset(h for h in r if r[h] == x) for x in set(r.values())}
    assert 1 < len(set(wanted.values())) < len(lines)
    assert same(got) == same(wanted)
    # the star alone
    star = [(e.a, e.b) for e in links.collect()]
    assert all(linked(*(lines[next(i for i in rows if rows[i][0] == h)] for h in e)) for e in star)
