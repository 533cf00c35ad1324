"""Edge cases and brute-force comparisons of the corpus operators on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm.queries import vocabulary

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: names that operators use inside or return
CLASH = ("id", "text2", "kept", "score", "n", "key", "row", "band", "digest", "n_tokens", "keep_id", "component_id", "maybe", "__text")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mé", "ti", "Su", "ra"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = sentence(rng, 150)
    words = base.split(" ")
    near = [" ".join(words[:i] + ["x%d" % i] + words[i + 1:]) for i in (3, 70, 140)]
    shared = sentence(rng, 60)
    rows = [None, "", " \n\t ", "one", "One", "two  words", "two words", "two\nwords", base, base, base.upper(), *near,
            sentence(rng, 30) + " " + shared + " " + sentence(rng, 40), sentence(rng, 55) + "\n" + shared, shared.replace(" ", "  ", 1),
            sentence(rng, 30_000), "\n".join(["Same line of some length here."] * 3 + [sentence(rng, 12)]), "<|endoftext|> a  b", "本語 é ß\xa0x"]
    return [*rows, *(sentence(rng, rng.randrange(1, 90)) for _ in range(40))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8])]  # one row comes twice
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for i, name in enumerate(CLASH):
        table = table.withColumn(name, F.lit(i))
    return table.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, kept int")


def shingles(text: str | None, k: int = 5) -> set:
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_token_counts_match_the_library(docs, nothing, texts):
    from tokenizers import Tokenizer

    from cutline.llm.token_counts import token_counts

    library = Tokenizer.from_file(vocabulary())
    got = token_counts(docs, vocabulary(), limit=20).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20)
    assert token_counts(nothing, vocabulary()).collect() == []


def test_segments_are_safe_boundaries():
    from tokenizers import Tokenizer

    from cutline.llm.encoding import SegmentEncoder, segments

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(2)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "1", "½", "é", "'s", "!", "<|endoftext|>", "\xa0", "\x85", "\x1c", "  ", "'", "　", "本", "́", "_", "."]
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(4000)]
    samples += [f"a{chr(c)}b {chr(c)} c {chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    encoder = SegmentEncoder(vocabulary(), keep=500, with_ids=True)  # small table: it is trimmed again and again
    for a in range(0, len(samples), 700):
        part = samples[a: a + 700]
        assert all("".join(segments(t)) == t for t in part)
        counts, ids = encoder.encode(part)
        ends = np.cumsum(counts)
        for t, n, e, want in zip(part, counts, ends, library.encode_batch(part, add_special_tokens=False)):
            assert ids[e - n: e].tolist() == want.ids, repr(t)


def test_packing_holds_every_token_once(docs, nothing, texts):
    from tokenizers import Tokenizer

    from cutline.llm.packing import packed_pieces

    library = Tokenizer.from_file(vocabulary())
    pieces = packed_pieces(docs, vocabulary(), group_tokens=2048).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    sequences, covered, groups = {}, Counter(), Counter()
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start: p.start + p.length], "<u4")
        assert len(own) == p.length > 0 and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        covered.update((p.doc_id, x) for x in range(p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append(p)
    assert covered == Counter({(i, x): 1 + (i == 8) for i in ids for x in range(len(ids[i]))})
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == own[0].tier <= 1024 and at & (at - 1) == 0
        groups[own[0].step_group, own[0].tier] += at
    assert all(v <= 2048 for v in groups.values())
    assert packed_pieces(nothing, vocabulary()).collect() == []


@pytest.mark.parametrize("filter_bytes", [64 << 20, 4096])
def test_exact_groups_by_brute_force(docs, texts, filter_bytes):
    from cutline.llm.exact_dedup import duplicate_groups

    key = [BLANKS.sub(" ", t or "") for t in texts]
    size = Counter(key) + Counter([key[8]])
    got = duplicate_groups(docs, filter_bytes=filter_bytes).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        keep = key.index(key[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (
            keep, size[key[r.doc_id]], keep == r.doc_id, hashlib.sha256(key[r.doc_id].encode()).hexdigest())


def test_exact_removal_keeps_columns_and_one_row_each(docs, nothing, texts):
    from cutline.llm.exact_dedup import duplicate_groups, without_duplicates

    key = [BLANKS.sub(" ", t or "") for t in texts]
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({key.index(k) for k in key})
    assert without_duplicates(nothing).collect() == [] and duplicate_groups(nothing).collect() == []


def test_rows_without_id(spark):
    from cutline.llm.exact_dedup import duplicate_groups, without_duplicates

    table = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in duplicate_groups(table).collect()), key=str)
    assert got == sorted([(3, 3, 3, True), (None, 3, 3, False), (None, 3, 3, False), (None, None, 2, True), (None, None, 2, True)], key=str)
    assert sorted((r.doc_id, r.text) for r in without_duplicates(table).collect() if r.doc_id) == [(3, "a")]
    assert without_duplicates(table).count() == 2


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_by_brute_force(docs, nothing, texts, percent):
    from cutline.llm.near_dedup import near_duplicates

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(range(len(sets)), links)
    got = near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    if percent == 80:
        assert near_duplicates(nothing).collect() == []


def test_a_chain_of_near_duplicates_is_one_component(spark):
    from cutline.llm.near_dedup import near_duplicates

    rng = random.Random(9)
    words = sentence(rng, 200).split(" ")
    chain = []
    for i in range(60):  # neighbours differ in two words, distant ones in most
        for at in rng.sample(range(200), 2):
            words[at] = f"w{i}{at}"
        chain.append(" ".join(words))
    order = list(range(60))
    rng.shuffle(order)
    table = spark.createDataFrame([(order[i], t) for i, t in enumerate(chain)], "doc_id bigint, text string")
    sets = {order[i]: shingles(t) for i, t in enumerate(chain)}
    want = roots(sets, [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in near_duplicates(table, percent=85).collect()} == want


def test_union_find(spark):
    from cutline.llm.graph import components

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5, 5)]
    want = roots({x for e in links for x in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == want[n] for n in want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def contaminated(texts, items, window=13):
    words = lambda t: ALNUM.findall((t or "").translate(LOW))
    out = {}
    for i, t in texts:
        own, hit, found = words(t), set(), set()
        for item, s in items:
            w = words(s)
            n = min(window, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                for b in range(len(own) - n + 1):
                    if own[b: b + n] == w[a: a + n]:
                        hit.update(range(b, b + n))
                        found.add(item)
        out[i] = (len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own))
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_contamination_by_brute_force(spark, index_bytes):
    from cutline.llm.decontamination import contamination

    rng = random.Random(index_bytes + 1)
    pool = [sentence(rng, 40) for _ in range(4)]
    items = [(0, pool[0]), (1, pool[1].upper()), (2, "short item words"), (3, ""), (4, None), (5, pool[0][:150] + " end"), (6, "short item words"), (7, "!!")]
    rows = [(0, pool[0]), (1, None), (2, ""), (3, "??"), (4, sentence(rng, 40) + ", " + pool[1] + " " + sentence(rng, 3)),
            (5, "a Short,item words b " * 3), (6, " ".join(pool[0].split(" ")[10:23])), (7, " ".join(pool[0].split(" ")[10:22])),
            (8, sentence(rng, 3000) + " " + " ".join(pool[1].split(" ")[:14])), (9, "short item"), (10, pool[0] + "\n" + pool[0])]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string").withColumn("items", F.lit(1)).withColumn("row", F.lit(2))
    bench = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").withColumn("id", F.lit(0))
    want = contaminated(rows, items)
    got = contamination(docs, bench, index_bytes=index_bytes).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want[r.doc_id], r.doc_id
    assert contamination(docs.limit(0), bench, index_bytes=index_bytes).collect() == []
    assert not any(r.n_hit for r in contamination(docs, bench.limit(0), index_bytes=index_bytes).collect())


def test_winnowing_catches_every_shared_span():
    import pyarrow as pa

    from cutline.llm.decontamination import fingerprints
    from cutline.llm.text import ALNUM_WORD, words_of

    rng = random.Random(4)
    for _ in range(200):
        span = sentence(rng, 13)
        pair = [sentence(rng, rng.randrange(20)) + " " + span + " " + sentence(rng, rng.randrange(20)) for _ in range(2)]
        words = words_of(pa.array(pair), ALNUM_WORD)
        at, h = fingerprints(words)
        sides = [set(h[words.doc[at] == i].tolist()) for i in (0, 1)]
        assert sides[0] & sides[1]


def test_lines_by_brute_force(spark, docs, nothing, texts):
    from cutline.llm.line_dedup import repeated_lines, without_repeated_lines

    rng = random.Random(8)
    line = sentence(rng, 20)
    own = [(i, t) for i, t in enumerate(texts)] + [(900, f"{line}\nother words"), (901, f"x\n\n {line.upper()} "), (902, line[:50] + "q" + line[51:]), (903, f"{line}\n{line}")]
    norm = lambda s: re.sub(r"\s+", " ", s.lower().strip())
    first = {}
    for i, t in own:
        for j, s in enumerate((t or "").split("\n")):
            first.setdefault(norm(s), (i, j))
    lines = [s for s in first if s]
    sets = {s: {s[k: k + 7] for k in range(len(s) - 6)} or {s} for s in lines}
    root = roots(lines, [(a, b) for a in lines for b in lines if a < b and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b]))
                         and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    winner = {}
    for s in lines:
        winner[root[s]] = min(winner.get(root[s], first[s]), first[s])
    table = spark.createDataFrame(own, "doc_id bigint, text string").withColumn("line", F.lit(1)).withColumn("hash", F.lit(2))
    got = {r.doc_id: (r.n_lines, r.n_kept, r.dropped) for r in repeated_lines(table).collect()}
    for i, t in own:
        all_lines = (t or "").split("\n")
        drop = [j for j, s in enumerate(all_lines) if norm(s) and winner[root[norm(s)]] != (i, j)]
        assert got[i] == (len(all_lines), len(all_lines) - len(drop), drop), i
    cleaned = {r.doc_id: r.text for r in without_repeated_lines(table).collect()}
    assert cleaned[0] is None and cleaned[901] == "x\n" and cleaned[903] == "" and cleaned[900] == f"{line}\nother words"
    assert repeated_lines(nothing).collect() == []


def test_passages(spark, nothing):
    from cutline.llm.passages import repeated_passages

    rng = random.Random(6)
    long, short = sentence(rng, 55), sentence(rng, 30)
    edited = long.split(" ")
    edited[27] = "changed"
    table = [(0, sentence(rng, 80) + " " + long + " " + sentence(rng, 70)), (1, long + " " + sentence(rng, 100)), (2, sentence(rng, 200)),
             (3, sentence(rng, 50) + " " + short + " " + sentence(rng, 50)), (4, short + " " + sentence(rng, 70)), (5, None), (6, ""),
             (7, sentence(rng, 33) + " " + " ".join(edited) + " " + sentence(rng, 33)), (8, long), (9, sentence(rng, 60))]
    docs = spark.createDataFrame([*table, table[9]], "doc_id bigint, text string").withColumn("name", F.lit(1)).withColumn("spans", F.lit(2))
    got = {r.doc_id: r for r in repeated_passages(docs, words=50).collect()}
    assert {i for i, r in got.items() if r.n_spans} == {0, 1, 7, 8} and set(got) == set(range(10))
    assert [tuple(s) for s in got[0].spans] == [(80, 135)] and got[8].n_repeated == 55 and got[1].spans[0].start == 0
    assert {got[i].component_id for i in (0, 1, 7, 8)} == {0} and got[2].component_id == 2
    assert repeated_passages(nothing).collect() == []


def test_compact_windows_are_the_tree():
    from cutline.llm.passages import compact_windows

    rng = np.random.default_rng(1)
    for width in (1, 2, 5):
        values = rng.integers(0, 12, 80).astype(np.uint64)
        doc = np.sort(rng.integers(0, 4, 80))
        want = set()

        def tree(a: int, b: int) -> None:
            if b - a >= width and b > a:
                c = a + int(np.argmin(values[a:b]))
                want.add((c, a, b - 1))
                tree(a, c)
                tree(c + 1, b)

        for d in range(4):
            tree(*(int(x) for x in np.searchsorted(doc, [d, d + 1])))
        assert set(zip(*(x.tolist() for x in compact_windows(values, doc, width)))) == want


def test_quality_votes(spark, docs, nothing, texts):
    from cutline.llm.quality import quality_scores

    rng = random.Random(1)
    good = [(sentence(rng, 40).lower() + ".", 1.0) for _ in range(60)]
    bad = [(" ".join(w.upper() + "!!" for w in sentence(rng, 40).split(" ")), 0.0) for _ in range(60)]
    rows = [(i, *r) for i, r in enumerate([*good, *bad, (None, 1.0), ("x", None)])]
    source = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").withColumn("label", F.lit("z"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 0.0), (7777, 0.0)], "doc_id bigint, label double")
    scored = quality_scores(docs, source, labels, sample=100)
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"] and scored.count() == len(texts) + 1
    by_text = {}
    for r in scored.collect():
        assert 0 <= r.score <= 1
        assert by_text.setdefault(r.text or "", r.score) == pytest.approx(r.score, abs=1e-5)
    test = spark.createDataFrame([(0, sentence(rng, 60).lower()), (1, "LOUD!! TEXT!! AND!! MORE!! OF!! IT!!" * 3)], "doc_id bigint, text string")
    assert [r.score > 0.7 for r in quality_scores(test, source, labels).orderBy("doc_id").collect()] == [True, False]
    assert {r.score for r in quality_scores(test, source, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(nothing, source, labels).collect() == []


def test_language_model(spark, docs, nothing, texts):
    from cutline.llm.language_model import language_model_scores

    train = F.col("doc_id") % 3 != 0
    tokens = [WORDS.findall((t or "").translate(LOW)) + [None] for t in texts]
    seen = Counter()
    for i in [*range(len(texts)), 8]:
        if i % 3:
            seen.update(tokens[i])
    n, v = sum(seen.values()), len(seen)
    got = language_model_scores(docs, train).collect()
    again = {r.doc_id: r.score for r in language_model_scores(docs, train).collect()}
    assert len(got) == len(texts) + 1
    for r in got:
        own = tokens[r.doc_id]
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 3 != 0, len(own), sum(seen[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in own))
        assert r.score == pytest.approx(again[r.doc_id]) and r.score < 0
    held = [r for r in got if not r.trained]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert {(r.base_score, r.score, r.perplexity) for r in language_model_scores(docs, F.lit(False)).collect()} == {(0.0, None, None)}
    assert language_model_scores(nothing, train).collect() == []


def test_preference_pairs(spark):
    from cutline.llm.preference import preference_examples

    said = [(1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "no"),
            (1, "rejected", 1, "assistant", "no"), (2, "chosen", 0, "user", None), (2, "rejected", 0, "user", ""), (3, "chosen", None, None, "s"),
            (3, "chosen", 2, "assistant", "é" * 5000), (4, "rejected", 0, "assistant", "only"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x")]
    turns = spark.createDataFrame(said, "pair_id bigint, side string, turn bigint, role string, text string").withColumn("pair", F.lit(9)).withColumn("split", F.lit(8))
    got = {r.pair_id: r for r in preference_examples(turns).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one.prompt == "<|im_start|>user\nq<|im_end|>\n" and one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    a, b = map(int, one.chosen_spans.split("-"))
    assert one.chosen[a:b] == "yes<|im_end|>\n" and one.rejected[slice(*map(int, one.rejected_spans.split("-")))] == "no<|im_end|>\n"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].prompt == "" and got[3].n_chosen_turns == 2 and got[3].chosen.startswith("<|im_start|>\ns<|im_end|>\n<|im_start|>assistant")
    assert got[4].chosen == "" and got[4].rejected_spans == "22-37"
    assert preference_examples(turns.limit(0)).collect() == []
