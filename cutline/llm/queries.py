"""Registered queries of the corpus operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutline.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: query(importable(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public byte-level vocabulary, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=512)


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.packing import packed_pieces

    return packed_pieces(table(spark, sf_dir, "documents"), vocabulary())


@register("op10_exact_dedup", r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.exact_dedup import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"))


@register("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@register("op2_winnowing", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(hit_words.n, 0)::BIGINT AS n_hit, coalesce(hit_items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AND 20 * coalesce(hit_words.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cutline.llm.decontamination import contamination, items_digest

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        items_digest("items").alias("items_sha256"), "contaminated")


def remainder(spark_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(spark_id).cast("string").cast("binary")) % modulus


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the rows from which quality may be learned."""
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select(
        "doc_id", F.col("quality").cast("double").alias("label"))


@register("op4_quality_neighbours")
def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cutline.llm.quality import quality_scores

    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs.select("doc_id", "text"), docs, quality_labels(spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op3_preference_pairs", r"""
WITH last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT c.conv_id AS pair_id, c.turn, c.role, c.text AS chosen,
         CASE WHEN c.turn = own.last_turn THEN next.answer ELSE c.text END AS rejected
  FROM conversations c LEFT JOIN last own USING (conv_id) LEFT JOIN last next ON next.conv_id = c.conv_id + 1),
turns AS (
  SELECT *, '<|im_start|>' || role || chr(10) AS head,
         '<|im_start|>' || role || chr(10) || chosen || '<|im_end|>' || chr(10) AS chosen_text,
         '<|im_start|>' || role || chr(10) || rejected || '<|im_end|>' || chr(10) AS rejected_text,
         min(CASE WHEN chosen IS DISTINCT FROM rejected THEN turn END) OVER (PARTITION BY pair_id) AS split FROM sides),
placed AS (
  SELECT *, split IS NULL OR turn < split AS shared,
         sum(CASE WHEN turn >= split THEN length(chosen_text) ELSE 0 END) OVER w AS chosen_end,
         sum(CASE WHEN turn >= split THEN coalesce(length(rejected_text), 0) ELSE 0 END) OVER w AS rejected_end
  FROM turns WINDOW w AS (PARTITION BY pair_id ORDER BY turn))
SELECT pair_id, count(*) FILTER (shared) AS n_prompt_turns, count(*) FILTER (NOT shared) AS n_chosen_turns,
  count(rejected) FILTER (NOT shared) AS n_rejected_turns,
  coalesce(string_agg(chosen_text, '' ORDER BY turn) FILTER (shared), '') AS prompt,
  coalesce(string_agg(chosen_text, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
  coalesce(string_agg(rejected_text, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
  coalesce(string_agg((chosen_end - length(chosen_text) + length(head)) || '-' || chosen_end, ',' ORDER BY turn)
    FILTER (NOT shared AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((rejected_end - length(rejected_text) + length(head)) || '-' || rejected_end, ',' ORDER BY turn)
    FILTER (NOT shared AND role = 'assistant' AND rejected IS NOT NULL), '') AS rejected_spans
FROM placed GROUP BY pair_id
""")
def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.preference import preference_examples, with_foreign_answers

    return preference_examples(with_foreign_answers(table(spark, sf_dir, "conversations")))


@register("op1_fuzzy_lines")
def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.line_dedup import repeated_lines

    return repeated_lines(table(spark, sf_dir, "documents"), percent=80)


@register("op8_compact_windows")
def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), words=50, percent=80)


@register("op6_pitman_yor")
def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cutline.llm.language_model import language_model_scores

    scored = language_model_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cutline.llm.periodic_runs import periodic_runs, with_planted_period

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(with_planted_period(docs, F.crc32(F.col("doc_id").cast("string").cast("binary"))))
    # the greatest run, ties to the smallest start and then period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("-1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@register("op12_page_text", r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'),
      '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS lines
  FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(lines, lambda b: b <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
""")
def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cutline.llm.page_text import page_texts

    found = page_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@register("op11_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
found AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4), (5)) sizes(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT lang, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS i FROM found WHERE k > 2))
  WHERE j - i + 1 < len(w) GROUP BY ALL),
candidates AS (SELECT lang, phrase, k, a FROM found LEFT JOIN longer USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, f.a AS l, s.a AS r, n, (1000 * c.a * n) // (f.a * s.a) AS score
  FROM cuts c JOIN totals ON totals.lang = c.lang JOIN found f ON f.lang = c.lang AND f.phrase = array_to_string(w[1 : cut], ' ')
  JOIN found s ON s.lang = c.lang AND s.phrase = array_to_string(w[cut + 1 : len(w)], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutline.llm.collocations import collocations, frequent_phrases

    return collocations(*frequent_phrases(table(spark, sf_dir, "documents"), least=100, longest=5), top=2000)
