"""Mixing and the two audits against brute force on small tables with nulls, empty and long texts, ties, repeats and
extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandlake.llm import divergence as dv
from strandlake.llm import interaction as ia
from strandlake.llm import mixing as mx

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"Word{i % 977} and, more." for i in range(30000))


def clashing(df):
    """The table with extra columns named like the operators' own."""
    for name in ("size", "target", "key", "slice", "copies", "name", "rank", "value", "item", "part", "fails", "sum", "n", "docs", "term"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "Cd", "éÉ", "ab1cd", "x", "漢字", "q_q", "#z", "EE"])
    out = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 250])))
        out.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None, "", "z"])))
    out += [(500, None, None, "a"), (501, "", "en", None), (None, "one two", "en", "b"), (None, "one two", "en", "b"), (None, None, None, None), (7, out[7][1], "en", "a"), (7, out[7][1], "en", "a")]
    out += [(600 + i, out[3][1], "de", "z") for i in range(5)] + [(700, LONG, "en", "a"), (701, "\t\x0b \n", "en", "a"), (702, "nul\x00tab", "en", "a")]
    return out


# --- mixing --------------------------------------------------------------------------------------------------------


def brute_mix(docs, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in docs]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    size = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    left, target, open_ = share * sum(size.values()), dict.fromkeys(sources, Fraction(0)), list(sources)
    while open_ and left:  # share out, stop those above, share the excess again
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - most * size[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], Fraction(most * size[s]))
        open_ = [s for s in open_ if target[s] < most * size[s]]
    out = []
    for s in sources:
        key = lambda r: (hashlib.md5(f"11:{'none' if r[0] is None else r[0]}".encode()).hexdigest()[:16], r[0] is not None, r[0] or 0, r[2])
        mine, budget = sorted((r for r in sized if r[1] == s), key=key), int(target[s])
        taken = [0] * len(mine)
        while budget and size[s]:
            for k, r in enumerate(mine):
                step = min(r[2], budget)
                taken[k] += step
                budget -= step
        out += [(r[0], s, r[2], size[s], round(float(target[s]), 6), t) for r, t in zip(mine, taken, strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    docs = made(seed)
    got = mx.mix(spark, clashing(spark.createDataFrame(docs, DOCS)).repartition(3)).withColumn("target", F.round("target", 6))
    assert rows(got, "doc_id", "source", "size", "source_size", "target", "taken") == brute_mix(docs)


def test_mix_with_other_weights_meets_each_target(spark):
    docs = spark.createDataFrame(made(5, 300), DOCS)
    got = mx.mix(spark, docs, weights=(1, 9), share=(7, 4), most=3)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("s"), F.sum("size").alias("n")).collect():
        assert r["t"] == int(r["target"]) and r["target"] <= 3 * r["s"] and r["s"] == r["n"]
    assert got.where("taken > 3 * size").count() == 0


def test_mix_of_many_copies_of_one_row_is_cut_exactly(spark):
    docs = [(1, "a b c", None, "s")] * 2500 + [(2, "d " * 9000, None, "t")] + [(3, "e", None, None)]
    got = mx.mix(spark, spark.createDataFrame(docs, DOCS))
    taken = Counter((r["source"], r["taken"]) for r in got.collect())
    assert sum(v for (s, _), v in taken.items() if s == "s") == 2500 and sum(k[1] * v for k, v in taken.items() if k[0] == "s") == int(got.where("source = 's'").first()["target"])
    assert rows(got.withColumn("target", F.round("target", 6)), "doc_id", "source", "size", "source_size", "target", "taken") == brute_mix(docs)


def test_mix_of_nothing(spark):
    assert mx.mix(spark, spark.createDataFrame([], DOCS)).count() == 0
    got = mx.mix(spark, spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], DOCS))
    assert rows(got, "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


def test_mix_does_not_depend_on_files(spark):
    docs = spark.createDataFrame(made(8), DOCS)
    a, b = (mx.mix(spark, docs.repartition(n)) for n in (1, 7))
    assert rows(a, *a.columns) == rows(b, *a.columns)


# --- divergence ----------------------------------------------------------------------------------------------------


def brute_divergence(docs, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(c):
            total = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            parts = {
                "pair": [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s],
                "term": [(t, of[s][t] - q[t]) for t in kept if counts[lang, s][t] and of[s][t] > q[t]],
            }
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(ranked)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,least,top", [(1, 3, 2), (2, 8, 50), (3, 10**6, 5)])
def test_divergence(spark, monkeypatch, seed, least, top):
    docs = made(seed)
    if seed == 2:  # hand counts on, and fold pairs, all the time
        monkeypatch.setattr(dv, "HELD", 4)
        monkeypatch.setattr(dv, "PAIRS", 3)
    got = dv.audit(spark, clashing(spark.createDataFrame(docs, DOCS)).repartition(3), least=least, top=top)
    assert rows(got, "lang", "source", "part", "item", "value", "rank") == brute_divergence(docs, least, top)


def test_divergence_sees_implied_zero_cells(spark):
    # Two sources without a common term: the distance comes from zero cells alone.
    docs = [(i, "left only", "en", "a") for i in range(4)] + [(9 + i, "right", "en", "b") for i in range(4)] + [(30, "1 2 3", "en", "c")]
    got = dv.audit(spark, spark.createDataFrame(docs, DOCS), least=3)
    assert rows(got, "lang", "source", "part", "item", "value", "rank") == brute_divergence(docs, 3, 50)
    assert got.where("source = 'c' and part = 'pair'").count() == 2 and got.where("source = 'c' and part = 'term'").count() == 0


def test_divergence_of_nothing(spark):
    assert dv.audit(spark, spark.createDataFrame([], DOCS)).count() == 0


# --- interaction ---------------------------------------------------------------------------------------------------


def brute_interaction(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        bad["E"] = text in first and (i is None or first[text] < i)
        return {k for k, v in bad.items() if v}

    parts = defaultdict(list)
    for i, text, lang, _ in docs:
        parts[lang or ""].append((i, fails(i, text or "")))
    out = []
    for part, members in parts.items():
        tally = {}
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, x in enumerate(order):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                tally[order, step + 1] = (len(left), len(gone), sum(x in m[1] for m in members) - len(gone), sum(m[1] == {x} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone))
        for (order, step), row in tally.items():
            out.append((part, order, step, *row, sum(r[1] for (o, s), r in tally.items() if o[s - 1] == order[step - 1])))
    return sorted(out, key=repr)


INTERACTION = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("seed", [1, 2])
def test_interaction(spark, monkeypatch, seed):
    docs = made(seed, 60)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 700, 2)] + [(4, 0, 0), (5, None, 1), (None, 1, 1), (6, 1, None)]
    if seed == 2:
        monkeypatch.setattr(ia, "PARTS", 1)
    got = ia.audit(spark, clashing(spark.createDataFrame(docs, DOCS)).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows(got, *INTERACTION) == brute_interaction(docs, labels)


def test_interaction_counts_copies_of_a_hot_text_table_wide(spark):
    docs = [(i, "same", "en" if i % 2 else "de", None) for i in range(900)] + [(1000 + i, f"other{i}", "en", None) for i in range(40)]
    got = ia.audit(spark, spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["removed"], r["kept"]) for r in got.where("filter_order = 'EABCD' and step = 1").collect()} == {("en", 450, 40), ("de", 449, 1)}


def test_interaction_of_nothing(spark):
    assert ia.audit(spark, spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_first_failures_follow_from_the_order():
    table = ia.first_failures()
    for o, order in enumerate(ia.orders()):
        for bits in range(32):
            bad = {x for i, x in enumerate(ia.LETTERS) if bits >> i & 1}
            assert table[bits, o] == next((s for s, x in enumerate(order) if x in bad), 5)
