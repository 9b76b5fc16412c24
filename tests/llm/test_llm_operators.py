"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import decontaminate as dc
from strandlake.llm import html_main as hm
from strandlake.llm import metric_search as ms
from strandlake.llm import near_dup as nd
from strandlake.llm import packing as pk
from strandlake.llm import quality as ql
from strandlake.llm import token_store as ts
from strandlake.llm import tool_calls as tc
from strandlake.llm import toxicity as tx
from strandlake.llm import url_filter as uf
from strandlake.llm.common import spread_join
from strandlake.llm.queries import ORACLES, QUERIES, SCHEMAS
from strandlake.llm.tokenizing import Encoder

DOCS = "doc_id long, text string"
LONG = " ".join(f"word{i % 977} and, more." for i in range(9000))


def clashing(df):
    """The table with extra columns named like the operators' own."""
    for name in ("score", "kept", "n", "key", "hub", "length", "rank", "start", "held_out", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


# --- op1 -----------------------------------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    fine = [(i, np.floor(256 * np.array(v, float))) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in sorted({(i, tuple(v)) for i, v in fine if i in queries}):
        found = sorted((-int(np.dot(x, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out, key=repr)


def test_metric_search_of_huge_components(spark, monkeypatch):
    """Scores that doubles do not hold are ranked as exact integers; scores beyond 64 bits come back at its ends."""
    monkeypatch.setattr(ms, "SAMPLE", 64)
    rng = random.Random(3)
    near = [(i, [float(2**41 + rng.choice([0, 1, 1 << 20])) * (1 if i % 3 else -1), float(rng.randrange(-(2**41), 2**41))]) for i in range(700)]
    ends = (-(1 << 63), (1 << 63) - 1)
    for vectors in (near, [*near, (700, [1e9] * 2), (750, [1e300, -1e17]), (751, [-1e300, 1e308])]):
        whole = {i: [min(max(int(np.floor(x)) * 256 if abs(x) < 2**70 else int(x), ends[0]), ends[1]) for x in v] for i, v in vectors}
        want = []
        for q in range(0, 800, 50):
            if q in whole:
                found = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
                want += [(q, r + 1, i, min(max(-s, ends[0]), ends[1])) for r, (s, i) in enumerate(found)]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        assert rows(ms.top_k(spark, df, "vec_id % 50 = 0", 5), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_metric_search(spark, monkeypatch):
    monkeypatch.setattr(ms, "SAMPLE", 64)
    rng = random.Random(1)
    vectors = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.4, 1.0]) + (i % 3) for _ in range(4)]) for i in range(900)]
    vectors += [(900 + i, vectors[7][1]) for i in range(300)]  # a hot vector, ties all over
    vectors += [(5000, None), (5010, []), (5020, [1.0, None, 1.0, 1.0]), (5030, [1.0, float("nan"), 0.0, 0.0]), (5040, [float("inf")] * 4), (None, [1.0] * 4), (5050, [1.0, 2.0])]
    df = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = rows(ms.top_k(spark, df, "vec_id % 100 = 0", 5), "query_id", "rank", "vec_id", "score")
    assert got == brute_top([v for v in vectors if v[1] is None or len(v[1]) != 2], set(range(0, 6000, 100)), 5)
    assert ms.top_k(spark, df.limit(0), "vec_id % 2 = 0").count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows(ms.top_k(spark, few, "vec_id = 0"), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 256 * 512)]


# --- op2 -----------------------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 1, "search", '{"query":"x", "limit": 3}', []), (1, "b", 3, "lookup", '{ "key" : 5 }', ["a", "a", "zz"]), (1, "c", 5, "convert", '{"value":1,"unit":"m"}', ["b", "a"]),
            (1, "d", 7, "other", "{}", ["e"]), (1, "e", 9, "search", "{not json", ["d"]), (1, "f", 11, "search", None, ["f"]), (1, "a", 0, "lookup", '{"key":"first"}', []),
            (2, "a", 1, "convert", '{"unit":"m"}', None), (2, "q", 2, "search", '[1]', ["a"]), (None, "x", 1, "search", "{}", []), (2, None, 1, "search", "{}", []),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>",
    ).withColumn("level", F.lit(9)).withColumn("fault", F.lit("x"))
    results = spark.createDataFrame([(1, "a", 2, 'say "hi"\n'), (1, "a", 4, "late"), (1, "zz", 3, "orphan"), (2, "a", 5, None)], "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in tc.link(spark, calls, results, SCHEMAS).collect()}
    assert {k: (r["level"], r["fault"], r["n_missing"], r["result_turn"]) for k, r in got.items()} == {
        (1, "a"): (0, None, 0, 2), (1, "b"): (1, "type:key", 1, None), (1, "c"): (2, None, 0, None), (1, "d"): (None, "unknown_tool", 0, None), (1, "e"): (None, "malformed", 0, None),
        (1, "f"): (0, "malformed", 1, None), (2, "a"): (0, "missing:value", 0, 5), (2, "q"): (1, "malformed", 0, None),
    }
    assert got[(1, "a")]["message"] == '{"arguments":{"key":"first"},"id":"a","name":"lookup","result":"say \\"hi\\"\\n"}'
    assert got[(1, "c")]["arguments"] == '{"unit":"m","value":1}'
    assert tc.link(spark, calls.limit(0), results, SCHEMAS).count() == 0


@pytest.mark.parametrize("most", [10_000, 3])
def test_levels_of_long_chains_and_large_conversations(spark, monkeypatch, most):
    monkeypatch.setattr(tc, "CALLS", most)
    n = 5000 if most > 100 else 6
    chain = spark.range(n).select(F.lit(7).alias("conv_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("call_id"), F.col("id").alias("turn"), F.lit("lookup").alias("name"), F.lit('{"key":"k"}').alias("arguments"), F.array(F.concat(F.lit("c"), (F.col("id") - 1).cast("string"))).alias("needs"))
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r["turn"]: (r["level"], r["n_missing"]) for r in tc.link(spark, chain, results, SCHEMAS).collect()}
    assert got == {i: (i, int(i == 0)) for i in range(n)}
    long = chain.limit(1).withColumn("arguments", F.lit('{"key":"' + LONG.replace('"', "") + '"}'))
    assert len(tc.link(spark, long, results, SCHEMAS).first()["arguments"]) > len(LONG)


# --- op3 -----------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1 << 40), max_size=600))
def test_elias_fano(values):
    values = sorted(values)
    ef = ts.EliasFano.from_bytes(ts.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    for first in range(0, len(values), 97):
        assert ef.run(first, min(len(values), first + 300)).tolist() == values[first : first + 300]


def test_elias_fano_of_many_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 900, 200_000)).astype(np.uint64)
    data = ts.EliasFano.of(values).to_bytes()
    assert len(data) * 8 / len(values) < 12 and ts.EliasFano.from_bytes(data).values().tolist() == values.tolist()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.sampled_from("ab Zé'ß \n\t.,!s123<|>İ日本  ")), max_size=6))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_runs_give_the_librarys_ids(name, texts):
    import pyarrow as pa

    e = _ENCODERS.setdefault(name, Encoder(public_tokenizers.path(name), bound=50))
    assert [bytes(x) for x in e.encode(pa.array([*texts, None], pa.string()))] == [e.whole(t) for t in [*texts, None]]


_ENCODERS = {}
TEXTS = [(5, "a b c"), (3, None), (9, ""), (7, "Don't stop.\n\nNow <|endoftext|> x"), (4, LONG), (-2, "neg"), (5, "a b c"), (None, "no id")]


def test_token_store(spark):
    got = ts.tokenized(spark, clashing(spark.createDataFrame(TEXTS, DOCS)), public_tokenizers.path("byte_bpe_50k.json"), 2, partitions=3).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert ts.tokenized(spark, spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_shard_random_access(tmp_path):
    w = ts.ShardWriter(f"file://{tmp_path}/s.ids", 2)
    for i in range(700):
        w.add(3 * i - 50, np.arange(i % 5, dtype=np.uint32))
    w.close()
    s = ts.Shard(f"file://{tmp_path}/s.ids")
    assert s.ids(604).tolist() == [0, 1, 2, 3] and s.doc_id(699) == 2047 and len(s.ids(5)) == 0
    assert [d for docs, _, _ in s.blocks(100) for d in docs] == [3 * i - 50 for i in range(700)]


def test_wide_vocabularies_take_four_bytes(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    big = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    big.pre_tokenizer = pre_tokenizers.Whitespace()
    big.save(str(tmp_path / "big.json"))
    got = ts.tokenized(spark, spark.createDataFrame([(1, "w69999 w3")], DOCS), str(tmp_path / "big.json"), 2).first()
    assert got["ids_crc32"] == zlib.crc32(np.array([69999, 3, 2], "<u4").tobytes())


# --- op4 -----------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, percent=80):
    cut = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()
    out = set()
    for d, text in docs:
        words = dc.item_words(text)
        for item, itext in items:
            own = dc.item_words(itext)
            if not own or not words:
                continue
            n, width = min(len(own), len(words)), min(5, len(own))
            for p in range(len(words) - n + 1):
                x, y = cut(words[p : p + n], width), cut(own, width)
                both = sum((x & y).values())
                if 100 * both >= percent * (sum(x.values()) + sum(y.values()) - both):
                    out.add((d, item))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 20, 37, 38, 60])))) for i in range(40)] + [(90, None), (91, ""), (92, "go go go go go go go go go go")]
    docs = []
    for i in range(120):
        text = [word() for _ in range(rng.randint(0, 150))]
        if i % 2:
            passage = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, 3)):
                passage[rng.randrange(len(passage))] = word()
            text[len(text) // 2 : len(text) // 2] = passage
        docs.append((i, " ".join(text).title() if i % 3 else ", ".join(text)))
    docs += [(500, None), (501, ""), (502, items[4][1][: len(items[4][1]) * 9 // 10]), (503, LONG + " " + items[5][1]), (504, "go " * 12)]
    want = brute_leaks([d for d in docs if d[0] != 503], items) + [(503, items[5][0])]
    got = rows(dc.contaminated(spark, clashing(spark.createDataFrame(docs + docs[:1], DOCS)), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id")
    # Items of fewer than five words are wholly there or not; longer ones may be missed only outside the radius.
    assert set(got) == set(want)
    clean = dc.without_contaminated(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert dc.contaminated(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 16, (60, dc.BLOCKS), dtype=np.uint16)
    index = dc.HammingIndex(prints)
    for k in range(60):
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, dc.RADIUS, replace=False)] = 1
        query = prints[k] ^ np.packbits(bits).view(np.uint16)
        near = np.flatnonzero(np.bitwise_count(prints ^ query).sum(1) <= dc.RADIUS)
        asked, found = index.near(np.stack([query, prints[k]]))
        assert found[asked == 0].tolist() == near.tolist() and k in near


@pytest.mark.parametrize("repeat", [0, 11])
def test_pairs_at_the_threshold_are_within_the_radius(repeat):
    """Recall of the sketch itself: pairs of weighted similarity 0.80 to 0.86, with and without repeated words."""
    rng, tried = random.Random(repeat), 0
    cut = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    while tried < 300:
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 120))] + ["go"] * repeat
        v = w[: len(w) - repeat] + ["no"] * repeat if tried % 2 else list(w)
        similar = 1.0
        while similar > 0.86:
            v[rng.randrange(len(v))] = f"x{rng.randint(0, 10**6)}"
            both = sum((cut(w) & cut(v)).values())
            similar = both / (2 * (len(w) - 4) - both)
        if similar >= 0.8:
            tried += 1
            assert 0 in dc.Items([(1, " ".join(w))], 80).search(" ".join(v))


def test_window_sums_count_occurrences():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 6, 40), np.zeros(30, int), rng.integers(0, 1 << 40, 40)):
        shingles = dc.mix64(values.astype(np.uint64))
        for span in (1, 7, 25):
            want = [dc.bit_rows(dc.elements(shingles[i : i + span], dc.occurrences(shingles[i : i + span]))).sum(0) for i in range(len(shingles) - span + 1)]
            assert (dc.window_sums(shingles, span) == np.array(want)).all()


def test_decontamination_in_lots_with_nulls(spark, monkeypatch):
    monkeypatch.setattr(dc, "LOT", 5)
    rng = random.Random(16)
    items = [(i if i % 7 else None, " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.choice([4, 25, 40])))) for i in range(24)] + [(-1, "one two three four five six seven")]
    docs = [(None, items[3][1]), (None, "nothing here"), (1, items[0][1]), (1, "clean text of row one"), (2, items[24][1] + " tail"), (2, items[24][1] + " tail"), (3, None)]
    schema = "item_id long, text string"
    got = rows(dc.contaminated(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, schema)), "doc_id", "item_id")
    assert got == sorted({(None, 3), (1, None), (2, -1)} | set(brute_leaks([d for d in docs if d[1] and d[1] not in (items[3][1], items[0][1]) and d[0] != 2], items)), key=repr)
    left = dc.without_contaminated(spark, clashing(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, schema))
    assert rows(left, "doc_id", "text") == sorted([docs[1], docs[3], docs[6]], key=repr) and "kept" in left.columns


# --- op5, op6 --------------------------------------------------------------------------------------------------------


def labelled(n, seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "tur", "en"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 4 == 0, i % 7 == 0
        text = [word() for _ in range(40)] + (["women"] if i % 3 == 0 else [])
        if toxic:
            text += rng.sample(["idiotus", "scumble", "trashy"], 2) + (["muslims"] if i % 8 == 0 else [])
        rng.shuffle(text)
        docs.append((i, " ".join(w + "&&&" if junk else w for w in text)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark):
    docs, labels = labelled(600)
    docs += [(9000, None), (9001, ""), (9002, LONG), (9003, "muslims met women"), (9004, "jews met men"), (None, "scumble idiotus trashy")]
    labels += [(None, 1, 1), (5, None, None), (77777, 1, 1)]
    got = {r["doc_id"]: r for r in tx.toxicity(spark, clashing(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(600) if got[i]["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert (got[9003]["predicted"], got[9004]["predicted"], got[None]["predicted"]) == (0, 0, 1)
    assert abs(got[9003]["score"] - got[9004]["score"]) < 0.1 and 0 <= got[9000]["score"] == got[9001]["score"] < 0.3
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in tx.toxicity(spark, spark.createDataFrame(docs[:3], DOCS), none).collect()} == {0}
    assert tx.toxicity(spark, spark.createDataFrame([], DOCS), none).count() == 0


def test_counterfactual_penalty_takes_weight_from_names():
    examples = [([0, 1], 1.0)] * 30 + [([1], 0.0)] * 5 + [([2], 0.0)] * 30 + [([0, 2], 1.0)] * 5
    twins = [([1], [2])] * 20
    free, fair = tx.fit(examples, [], 3), tx.fit(examples, twins, 3, fairness=20.0)
    assert abs(fair[1] - fair[2]) < abs(free[1] - free[2])
    assert tx.change(fair, twins) < 0.5 * tx.change(free, twins)


def test_learned_groups_hold_words_of_the_same_texts():
    presence = np.zeros((100, 4), bool)
    presence[:50, :2] = True
    presence[50:, 2:] = True
    assert tx.learned_groups(["mira", "tolo", "hana", "suvi"], presence) == [("mira", "tolo"), ("hana", "suvi")]
    assert tx.swaps([("a", "b"), ("b", "c")]) == {"a": "b", "b": "a", "c": "b"}


def test_penalty_on_terms_learned_from_labelled_texts(spark, tmp_path):
    """Groups that no list names: their first letters are those of insults, and the penalty takes that weight away."""
    rng, docs, labels = random.Random(12), [], []
    for i in range(800):
        toxic = i % 4 == 0
        # Neutral mentions of two groups; insults share the beginning of one group's name.
        text = [rng.choice(["ba", "lo", "mi"]) + rng.choice(["tur", "en", "sa"]) for _ in range(30)] + (["scumari"] if rng.random() < 0.3 else []) + (["velanor"] if rng.random() < 0.3 else [])
        docs.append((i, " ".join(text + (rng.sample(["scumble", "scumhead", "trashy"], 1) if toxic else []))))
        labels.append((i, 1, int(toxic)))
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    chosen, examples, twins = tx.examples_of(spark, frame, marks, tx.Scratch(spark, "t"), identities=())
    assert twins
    free, fair = tx.fit(examples, [], len(chosen)), tx.fit(examples, twins, len(chosen))
    assert tx.change(fair, twins) < tx.change(free, twins)
    got = {r["doc_id"]: r["predicted"] for r in tx.toxicity(spark, frame, marks, identities=()).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(800)) > 780


def test_rows_are_rejected_one_by_one(spark):
    docs, labels = labelled(400)
    bad, junk = "scumble idiotus trashy", " ".join(["ba&&& lo&&& mi&&&"] * 12)
    docs += [(None, bad), (None, docs[1][1]), (2, bad), (2, docs[2][1]), (9001, junk), (9001, docs[5][1])]
    frame, marks = clashing(spark.createDataFrame(docs, DOCS)).withColumn("log_weight", F.lit(1)), spark.createDataFrame(labels, LABELS)
    for out, gone in ((tx.without_toxic(spark, frame, marks), bad), (ql.resampled(spark, frame, marks), junk)):
        assert out.columns == frame.columns
        left = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
        extra = Counter(d for d in docs[400:] if d[1] not in (bad, junk))
        assert not extra - left and not any(t == gone for _, t in left)
        assert out.limit(0).count() == 0
    assert tx.without_toxic(spark, frame.limit(0), marks).count() == ql.resampled(spark, frame.limit(0), marks).count() == 0


def test_quality(spark):
    docs, labels = labelled(400)
    extra = [(9000, None), (9001, ""), (None, "ba lo mi"), (9002, LONG)]
    got = {r["doc_id"]: r for r in ql.importance_resample(spark, clashing(spark.createDataFrame(docs + extra + docs[1:2], DOCS)), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)).collect()}
    assert sum(got[i]["kept"] == (i % 7 != 0) for i in range(400)) >= 398
    assert got[9000]["log_weight"] == got[9001]["log_weight"] == 0 and got[None]["key"] is not None
    none = spark.createDataFrame([], LABELS)
    assert all(r["kept"] for r in ql.importance_resample(spark, spark.createDataFrame(docs[:9], DOCS), none).collect())
    assert ql.importance_resample(spark, spark.createDataFrame([], DOCS), none).count() == 0


def test_log_weights_against_brute_force(spark):
    docs, labels = labelled(90)
    good = {i for i, q, _ in labels if q}
    raw, target = Counter(), Counter()
    for i, text in docs:
        own = Counter(ql.ngrams([text])[0].tolist())
        raw += own
        if i in good:
            target += own
    share = lambda model, b: (model[b] + 1) / (sum(model.values()) + ql.BUCKETS)
    got = ql.importance_resample(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), k=30).collect()
    for r in got:
        own = ql.ngrams([docs[r["doc_id"]][1]])[0].tolist()
        want = sum(min(4.0, max(-4.0, np.log(share(target, b) / share(raw, b)))) * raw[b] / (raw[b] + ql.RARE) for b in own)
        assert abs(r["log_weight"] - want) < 1e-6 and r["n_grams"] == len(own)
    assert sum(r["kept"] for r in got) == 30 and {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in sorted(got, key=lambda r: (-r["key"], r["doc_id"]))[:30]}


def test_copies_of_a_text_count_once_in_the_raw_model(spark):
    texts = spark.createDataFrame([("a b",)] * 40 + [("c d",), (None,), (None,)], "text string")
    got = ql.counted(ql.with_shares(texts))
    assert got.max() <= 2.0 and abs(got.sum() - len(ql.ngrams(["a b", "c d"])[0])) < 1e-4


def test_shares_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    pair = [("a b",)] * 2 + [("e f",)] * 300 + [("",)] * 150 + [(None,)]
    few = ql.with_shares(spark.createDataFrame(pair, "text string"))
    many = spark.createDataFrame(pair, "text string").union(spark.range(30_000).selectExpr("concat('t', id)"))
    monkeypatch.setattr(ql, "FEW", 1)  # the shuffled way
    for shares in (few, ql.with_shares(many)):
        got = shares.groupBy("text", "share").agg(F.count("*").alias("n")).where("text not like 't%'").collect()
        assert {tuple(r) for r in got} == {("a b", 0.5, 2), ("e f", 1 / 300, 300), ("", 1 / 150, 150)}
        assert shares.where("text like 't%' and share <> 1").count() == 0


def test_noise_draws_in_proportion_to_weights(spark):
    """Of two kinds whose weights are as 3 to 1, a draw takes about three of one for one of the other."""
    frame = spark.createDataFrame([(i, f"t{i}", float(np.log(3)) if i % 2 else 0.0) for i in range(20_000)], "doc_id long, text string, w double")
    keyed, drawn = ql.draw(frame, 1000, "w", "key")
    heavy = [r["doc_id"] % 2 for r in keyed.where(drawn).collect()]
    assert len(heavy) == 1000 and 0.70 < sum(heavy) / 1000 < 0.80
    cold, first = ql.draw(frame, 1000, "w", "key", temperature=1e-6)
    assert cold.where(first).where("w = 0").count() == 0


def test_calibration_counts_the_good():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 4, 20_000)
    y = rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * x + 1)))
    a, b = ql.calibrated(list(zip(x.tolist(), y.astype(int).tolist(), strict=True))[:5000])
    assert abs(a - 0.7) < 0.08 and abs(b - 1) < 0.15
    assert ql.calibrated([(5.0, 1)] * 10)[1] > 0


@pytest.mark.parametrize("k", [1, 17, 500, 1000])
def test_top_k_by_narrowing(spark, k):
    rng = random.Random(k)
    values = [(i, rng.choice([1.5, 2.5, rng.random() * 1e6, rng.random()])) for i in range(1000)]
    want = sorted(values, key=lambda x: (-x[1], x[0]))[k - 1]
    assert ql.top_k(spark.createDataFrame(values, "doc_id long, key double"), k) == (want[1], want[0])


# --- op7 -----------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=80)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 6), max_size=8))
def test_bins_hold_every_piece(counts):
    groups = pk.bin_completion(counts, 50)
    used = Counter()
    for pattern, n in groups:
        assert sum(x * k for x, k in pattern.items()) <= 50
        for x, k in pattern.items():
            used[x] += k * n
    assert used == Counter(counts)
    assert sum(n for _, n in groups) <= sum(n for _, n in pk.best_fit(counts, 50))
    assert sum(n for _, n in groups) >= pk.lower_bound(counts, 50)


def fewest_bins(pieces, capacity):
    best = [len(pieces)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + pieces[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + pieces[i], *bins[k + 1 :]])
        go(i + 1, [*bins, pieces[i]])

    go(0, [])
    return best[0]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(8, 30), max_size=9))
def test_small_packings_are_optimal(pieces):
    assert sum(n for _, n in pk.bin_completion(Counter(pieces), 50)) == fewest_bins(sorted(pieces, reverse=True), 50)


def brute_fillings(stock, room):
    """Undominated fillings by their definition: no other filling whose pieces hold this one's, in disjoint subsets."""
    pieces = [x for x, n in stock.items() for _ in range(n)]
    every = {tuple(sorted(c, reverse=True)) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= room}

    def holds(a, b):
        if not b:
            return True
        return any(b[0] <= a[i] and holds(tuple(sorted([*a[:i], a[i] - b[0], *a[i + 1 :]], reverse=True)), b[1:]) for i in range(len(a)))

    return {b for b in every if not any(a != b and holds(a, b) for a in every)}


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 2), min_size=1, max_size=5), st.integers(1, 24))
def test_undominated_fillings(stock, room):
    got = [tuple(sorted(f, reverse=True)) for f in pk.undominated(pk.Stock(stock, 24), room)]
    assert len(got) == len(set(got)) and set(got) == brute_fillings(stock, room)
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(8, 30), max_size=9))
def test_unlimited_search_is_exhaustive(pieces):
    groups = pk.bin_completion(Counter(pieces), 50, math.inf, math.inf, math.inf)
    assert sum(n for _, n in groups) == fewest_bins(sorted(pieces, reverse=True), 50)


def test_limits_of_the_search_can_be_lifted(spark, monkeypatch):
    stock = pk.Stock({x: 1 for x in range(1, 13)}, 40)
    every, few = ([tuple(f) for f in pk.undominated(stock, 30, None, looks)] for looks in (math.inf, 0))
    assert few == every[: len(few)] and len(few) < len(every)
    seen = []
    monkeypatch.setattr(pk, "bin_completion", lambda counts, capacity, *limits: seen.append(limits) or pk.best_fit(counts, capacity))
    assert pk.pack(spark, spark.createDataFrame(TEXTS[:3], DOCS), public_tokenizers.path("word_bpe_49k.json"), 1, 64, math.inf, math.inf, math.inf).count() >= 3
    assert seen == [(math.inf,) * 3]


def test_completion_finds_fewer_bins_than_best_fit():
    rng = random.Random(1)
    counts = Counter(rng.randint(500, 1500) for _ in range(1000))
    assert sum(n for _, n in pk.bin_completion(counts, 4096, 600, 100)) < sum(n for _, n in pk.best_fit(counts, 4096))


def test_packing_joins_ranks_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * (i % 17)) for i in range(300)], DOCS)
    path = public_tokenizers.path("word_bpe_49k.json")
    few = rows(pk.pack(spark, docs, path, 1, 64), "doc_id", "piece", "sequence_id", "offset")
    monkeypatch.setattr(pk, "FEW", 3)
    assert rows(pk.pack(spark, docs, path, 1, 64), "doc_id", "piece", "sequence_id", "offset") == few


def test_packing(spark):
    got = pk.pack(spark, clashing(spark.createDataFrame(TEXTS, DOCS)), public_tokenizers.path("word_bpe_49k.json"), 1, 64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in TEXTS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 64):
            want[(i, k // 64, k, len(ids[k : k + 64]), ids[k : k + 64].tobytes())] += 1
    assert Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[:5]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == -(-sum(r["length"] for r in got) // 64)
    assert pk.pack(spark, spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


# --- op8 -----------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    entries = spark.createDataFrame(
        [("example.org", "2024-01-10", True), ("example.org", "2024-02-01", False), ("a.example.org", "2024-01-05", True), ("b.net/spam", "2024-01-01", True), ("b.net/spam", "2024-01-01", False), (None, "2024-01-01", True), ("c.net", None, True)],
        "pattern string, day string, active boolean",
    ).withColumn("day", F.to_date("day"))
    captures = spark.createDataFrame(
        [
            (1, "http://x.example.org/p", "2024-01-09"), (2, "https://u@X.Example.org:8080/p?q", "2024-01-10"), (3, "http://example.org", "2024-02-01"), (4, "http://a.example.org/", "2024-01-20"), (4, "http://a.example.org/", "2024-01-20"),
            (5, "http://b.net/spam/1", "2024-03-01"), (6, "http://b.net/ham", "2024-03-01"), (7, None, "2024-01-20"), (8, "not a url", "2024-01-20"), (9, "http://example.org/", None), (10, "http://org/", "2024-01-20"),
        ],
        "page_id long, url string, day string",
    ).withColumn("day", F.to_date("day")).withColumn("blocked", F.lit("x")).withColumn("valid_from", F.lit(1))
    got = rows(uf.evaluate(spark, captures, entries), "page_id", "blocked", "n_matches", "pattern")
    assert got == sorted(
        [(1, False, 0, None), (2, True, 1, "example.org"), (3, False, 0, None), (4, True, 2, "a.example.org"), (4, True, 2, "a.example.org"), (5, True, 1, "b.net/spam"), (6, False, 0, None), (7, False, 0, None), (8, False, 0, None), (9, False, 0, None), (10, False, 0, None)],
        key=repr,
    )
    assert uf.evaluate(spark, captures, entries.limit(0)).where("blocked").count() == 0
    # One hot host, on one day, and a shared parent domain; a very long url.
    hot = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, F.lit("hot.example.org")).otherwise(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org"))), F.lit("/p"), F.repeat(F.lit("x"), F.when(F.col("id") == 5, 50_000).otherwise(1))).alias("url"), F.to_date(F.lit("2024-01-15")).alias("day"))
    found = uf.evaluate(spark, hot, entries).groupBy("blocked", "n_matches", "pattern", "listed_from").count().collect()
    assert [(r["blocked"], r["n_matches"], r["pattern"], str(r["listed_from"]), r["count"]) for r in found] == [(True, 1, "example.org", "2024-01-10", 4000)]
    assert uf.evaluate(spark, captures.limit(0), entries).count() == 0


# --- op9 -----------------------------------------------------------------------------------------------------------


def brute_components(docs, width):
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(frozenset(nd.shingle_set(t, width).tolist()))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def near_copies():
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99999)}"
        docs.append((i, " ".join(w)))
    drift = list(base)
    for i in range(60, 90):
        for _ in range(3):
            drift[rng.randrange(len(drift))] = f"y{rng.randint(0, 99999)}"
        docs.append((i, " ".join(drift)))
    return docs + [(90, None), (91, ""), (92, "One two"), (93, "ONE  two"), (94, " \t"), (95, LONG), (96, LONG + " tail"), (97, docs[3][1]), (97, docs[3][1])]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, monkeypatch, width):
    monkeypatch.setattr(nd, "BLOCK", 16)
    docs = near_copies()
    got = rows(nd.near_duplicates(spark, clashing(spark.createDataFrame([*docs, (None, "a b c d e f")], DOCS)), width), "doc_id", "n_shingles", "component_id", "kept")
    want = brute_components(docs, width)
    assert {(r[0], r[2]) for r in got if r[0] is not None} == set(want.items())
    assert all(r[3] == (r[0] is None or r[0] == r[2]) for r in got) and len(got) == len(docs) + 1
    assert {r[1] for r in got if r[0] in (90, 91, 94)} == {0}
    rest = nd.without_near_duplicates(spark, clashing(spark.createDataFrame(docs, DOCS)).withColumn("row", F.lit(1)), width)
    assert sorted(r["doc_id"] for r in rest.collect()) == sorted(i for i, c in want.items() if i == c) and "row" in rest.columns
    assert nd.near_duplicates(spark, spark.createDataFrame([], DOCS), width).count() == 0


def test_copies_go_row_by_row(spark):
    docs = near_copies()
    text = docs[3][1]
    more = [(None, text), (None, "quite another text of no copy"), (None, "quite another text of no copy"), (3, "a second text under the same id"), (-5, text), (None, None), (None, None)]
    rest = nd.without_near_duplicates(spark, spark.createDataFrame(docs + more, DOCS), 5)
    got = Counter(tuple(r) for r in rest.collect())
    of = lambda t: sum(n for (_, x), n in got.items() if x == t)
    assert of(text) == 1 and got[(-5, text)] == 1 and of(more[1][1]) == 1 and got[more[3]] == 1 and got[(None, None)] == 2


def test_spread_join_of_hot_keys(spark):
    left = spark.createDataFrame([(i % 3 if i % 10 else i, i) for i in range(3000)], "k long, v long")
    lookup = left.groupBy("k").count().withColumn("w", F.col("k") * 2)
    want = rows(left.join(lookup.drop("count"), "k"), "k", "v", "w")
    assert rows(spread_join(left, lookup, ["k"], "count", 2), "k", "v", "w") == want
    assert rows(spread_join(left, lookup.where("k > 1"), ["k"], "count", 2, "left"), "k", "v", "w") == rows(left.join(lookup.where("k > 1").drop("count"), "k", "left"), "k", "v", "w")


def test_circulant_signature_is_the_shifted_permutation():
    shingles = nd.shingle_set("one two three four five six seven", 3)
    points = (nd.mix64(shingles) >> np.uint64(64 - nd.BITS)).astype(int)
    turn = np.random.default_rng(20).permutation(1 << nd.BITS)
    want = [min(turn[(p + k) % (1 << nd.BITS)] for p in points) for k in range(nd.COORDINATES)]
    assert nd.signature(shingles).tolist() == want


# --- op10 ----------------------------------------------------------------------------------------------------------

WORDS = " ".join(["alpha beta gamma delta"] * 8)


def p(x):
    return f"<p>{x}</p>"


PAGES = {
    f'<html><body><div id="nav"><a>Home</a></div><div class="content"><h1>T</h1>{p(WORDS)}{p("short.")}<aside>rel</aside>{p("end")}</div><div class="sidebar">{p(WORDS)}</div><div class="comments">{p(WORDS)}</div><footer>c</footer></body></html>': f"T\n\n{WORDS}\n\nshort.\n\nend",
    f'<body><header><h1>Site</h1><nav>x</nav></header><article><header><h1>Title here</h1></header>{p(WORDS)}<div class="ad">Buy now</div><form><input><button>Go</button></form><script>var x="</p>";</script>{p("a &amp; b&nbsp;c<br>d <b>e</b>f")}<ul><li>one</li><li>two</li></ul><section class="comments"><article>{p("nice post " * 20)}</article></section></article><div id="cookie-notice">{p("We use cookies " * 9)}</div></body>': f"Title here\n\n{WORDS}\n\na & b c d ef\n\none\n\ntwo",
    f"<html><body>{p('first')}{p(WORDS)}{p('tail')}</body></html>": f"first\n\n{WORDS}\n\ntail",
    "<body><article><p>one<p>two<b>x<p>three<br></article><footer>z</footer>": "one\n\ntwox\n\nthree",
    "no tags at  all": "no tags at all",
    "<nav>a b</nav>": "",
    "": "",
    None: "",
}


def test_main_text(spark):
    made = list(PAGES.items())
    df = clashing(spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(made)] + [(None, None, "<p>x y</p>")], "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in hm.extract(spark, df).collect()}
    assert [got[i]["text"] for i in range(len(made))] == [w for _, w in made]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[None]["text"] == "x y"
    assert hm.extract(spark, df.limit(0)).count() == 0


HARD = {
    "<p title=it's>one two three</p><p>four's end</p>": "one two three\n\nfour's end",
    "<article><p>before <script>var x='</p><p>';</script>after</p></article>": "before after",
    f'<body class="has-sidebar"><div class="sidebar">{p("links")}</div><article>{p(WORDS)}</article></body>': WORDS,
    f'<div id="content" class="with-sidebar">{p(WORDS)}</div>': WORDS,
    f'<div class="sidebar"><h1>T</h1>{p(WORDS)}</div><footer>x</footer>': f"T\n\n{WORDS}",
    f'<article>{p("one")}<div class="share-price">{p(WORDS)}</div><h2 class=meta-title>two</h2><div class="social share">tweet</div></article>': f"one\n\n{WORDS}\n\ntwo",
    "<p>a < b and c <5</p>": "a < b and c <5",
    "<p>x<!-- > <p>no</p> --> y</p><![CDATA[z]]><template><p>no</p></template>": "x y",
    "<p>last <b": "last",
    f"<article>{p('x')}<form><p>name</p></form><table><tr><td>a</td><td>b</td></tr></table></article>": "x\n\na\n\nb",
}


def test_main_text_of_hard_pages(spark):
    made = [*HARD.items(), *list(HARD.items())[:1]]
    got = hm.extract(spark, spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: w for i, (_, w) in enumerate(made)}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.floats(-5, 5).map(lambda x: round(x, 1)), max_size=25))
def test_best_run_against_all_runs(scores):
    first, last = hm.best_run(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
    assert (first, last) == (0, -1) if best <= 0 else abs(sum(scores[first : last + 1]) - best) < 1e-9


def test_long_pages_take_linear_time():
    import time

    def seconds(page):
        began = time.process_time()
        list(hm.markup(page))
        return time.process_time() - began

    for piece in ('<a "', "<a x='>", "<p>word </p>", "<!-", "</", '<a b="c'):
        short, long = seconds(piece * 20_000), seconds(piece * 200_000)
        assert long < 30 * short + 0.5


def test_the_scan_alone_finds_the_article(spark):
    """With every word alike, whatever the names around it, the costs of tags part the article from the rest."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = hm.train(pages)
    named, alone = hm.Model(*hm.prior()), 0
    named.weights, named.costs = {}, model.costs
    rows_ = pages.select("html").collect()
    for (source,) in rows_:
        page = hm.Page(source)
        first, last = hm.best_run(named.scores(page, [hm.NEUTRAL] * len(page.contexts)))
        inside = [k for k, (_, parent, name) in enumerate(page.contexts) if name == "article"]
        words = [c for c, tag, _ in page.tokens[first : last + 1] if not tag]
        alone += all(any(k in _path(page, c) for k in inside) for c in words)
    assert alone > 0.9 * len(rows_)


def _path(page, k):
    out = []
    while k >= 0:
        out.append(k)
        k = page.contexts[k][1]
    return out
