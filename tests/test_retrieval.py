import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import retrieval as rt


def test_split_text_limits_and_overlap():
    body = "\n\n".join(" ".join(f"word{i}_{j}" for j in range(60)) + "." for i in range(8))
    chunks = rt.split_text(body, 200, 40)
    assert max(map(len, chunks)) <= 200
    words = {w for c in chunks for w in c.replace(".", " ").split()}
    assert {w for w in body.replace(".", " ").split()} <= words
    assert rt.split_text("x" * 1000, 300, 50) and all(len(c) <= 300 for c in rt.split_text("x" * 1000, 300, 50))
    assert rt.split_text("short") == ["short"] and rt.split_text("") == []
    with pytest.raises(ValueError):
        rt.check_chunking(64, 64)


def test_split_text_by_level():
    # no separator: windows with overlap
    assert [len(c) for c in rt.split_text("x" * 1000, 300, 50)] == [300, 300, 300, 250]
    # a short paragraph is not glued to the head of a long one
    short, long = "a" * 100, " ".join(["bcde"] * 120)
    chunks = rt.split_text(f"{short}\n\n{long}", 300, 50)
    assert chunks[0] == short and all(c.startswith("bcde") and len(c) <= 300 for c in chunks[1:])
    # trailing pieces of a chunk open the next one
    assert rt.split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]


def test_stride_chunks_cover_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(1500))
    rows = rt.stride_chunks(spark.createDataFrame([(1, body), (2, "")], "doc_id int, text string")).orderBy("chunk_index").collect()
    text = rows[0]["chunk_text"] + "".join(r["chunk_text"][64:] for r in rows[1:])
    assert text == body and {r["doc_id"] for r in rows} == {1}


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "QUERY_BLOCK", block)
    monkeypatch.setattr(rt, "VECTOR_SLICE", 12 * block)
    g = np.random.default_rng(0)
    v, q = g.integers(0, 4, (400, 5)).astype(float), g.integers(0, 4, (7, 5)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, query_vector array<double>")
    got = {}
    for r in rt.nearest(vectors, queries, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    for i, x in enumerate(q):
        d = ((v - x) ** 2).sum(1)
        want = sorted((float(d[j]), j) for j in range(400))[:5]
        assert [(b, c) for _, b, c in sorted(got[i])] == want


def test_nearest_without_vectors_or_queries(spark):
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0])], "query_id bigint, query_vector array<double>")
    assert rt.nearest(vectors, queries).count() == 0
    assert rt.nearest(vectors, queries.limit(0)).count() == 0


def test_context_has_marker_without_hits(spark):
    queries = spark.createDataFrame([(1, "a < b", None)], "query_id bigint, question string, context string")
    hits = spark.createDataFrame([], "query_id bigint, vec_id bigint, rank int")
    chunks = spark.createDataFrame([], "vec_id bigint, chunk_text string")
    prompt = rt.assemble_context(queries, hits, chunks, "vec_id").first()["prompt"]
    assert rt.NO_DOCUMENTS in prompt and "a &lt; b" in prompt and rt.NO_CONTEXT in prompt


def test_cell_index_with_every_cell_probed_is_exact(spark, monkeypatch):
    """Hot cell in slices, queries in blocks, nulls, equal vectors: all cells give what exact search gives."""
    import numpy as np

    from cutline.operators import retrieval

    monkeypatch.setattr(retrieval, "VECTOR_SLICE", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist() if i % 3 else [0.5] * 4) for i in range(120)] + [(500, None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = vectors.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    index = retrieval.cell_index(vectors, cells=6)
    pairs = lambda df: {(r.query_id, r["rank"], r.vec_id) for r in df.collect()}
    assert pairs(index.nearest(asked, probes=6)) == pairs(retrieval.nearest(vectors, asked))
    assert 1 <= index.probes_for(recall=0.9) <= 6
    empty = retrieval.cell_index(vectors.limit(0))
    assert empty.nearest(asked.limit(0), probes=1).count() == 0


def test_missing_chunk_numbers_follow_list_positions(spark):
    from cutline.operators import retrieval

    have = spark.createDataFrame([("s", 1, 0, "x")], "source string, doc_id bigint, chunk_index int, chunk_text string")
    added = spark.createDataFrame([("s", 1, None, "z", 5), ("s", 1, None, "b", 90), ("s", 1, None, "a", 30), ("s", 2, 7, "q", 1)],
                                  "source string, doc_id bigint, chunk_index int, chunk_text string, at int")
    got = {(r.doc_id, r.chunk_index, r.chunk_text) for r in retrieval.append_collection(have, added, "at").collect()}
    assert got == {(1, 0, "x"), (1, 0, "z"), (1, 1, "a"), (1, 2, "b"), (2, 7, "q")}


def test_recall_asks_every_vector_of_all(spark, tmp_path):
    from cutline.plans.registry import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["R3_cell_index_recall"](spark, str(tmp_path)).collect()] == [(120, True, True)]


def test_nearest_keeps_ties_of_one_lane_apart(spark, monkeypatch):
    """Equal and nearly equal vectors that lie in the same lane of minima, several for a query, in larger query blocks."""
    monkeypatch.setattr(rt, "QUERY_BLOCK", 8)
    g = np.random.default_rng(1)
    v = np.repeat(g.normal(size=(150, 3)), 8, axis=0)
    v[::5] += 1e-7
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").coalesce(1)
    queries = vectors.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    got = {}
    for r in rt.nearest(vectors, queries, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i in range(0, len(v), 4):
        d = ((v - v[i]) ** 2).sum(1)
        assert [b for _, b in sorted(got[i])] == [j for _, j in sorted((float(d[j]), j) for j in range(len(v)))[:7]], i
