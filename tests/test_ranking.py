"""Set-similarity joins and the search by all scores beside brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from earshot.functions import similarity as X
from earshot.operators import retrieval as V
from earshot.operators import setjoin as J


def sets(rng, n, tokens):
    """Sets with a token that nearly all of them hold and a tail of rare ones."""
    return {i: sorted({"hot"} | {f"t{min(int(rng.expovariate(0.15)), tokens)}" for _ in range(rng.randint(0, 9))}
                      if rng.random() < 0.9 else {f"r{rng.randint(0, 9)}" for _ in range(rng.randint(0, 4))}) for i in range(n)}


def frame(spark, rows, key, least=None):
    schema = f"{key} long, tokens array<string>" + (", at_least double" if least else "")
    return spark.createDataFrame([(i, t, *([least[i]] if least else [])) for i, t in rows.items()], schema)


def similar(a, b, measure):
    shared = len(set(a) & set(b))
    return shared and (shared / (len(a) * len(b)) ** 0.5 if measure == "cosine" else 2 * shared / (len(a) + len(b)))


@pytest.mark.parametrize("measure, limit", [("cosine", J.BROADCAST_BYTES), ("dice", 0), ("cosine", 0)])
def test_similar_sets_equal_brute_force(spark, monkeypatch, measure, limit):
    monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    left, right = sets(rng, 120, 40), sets(rng, 150, 40)
    for at_least in (0.3, 0.75, 1.0):
        got = {tuple(r) for r in J.similar_sets(frame(spark, left, "left_id"), frame(spark, right, "right_id"), at_least, measure).collect()}
        want = {(i, j, len(set(a) & set(b)), len(a), len(b)) for (i, a), (j, b) in itertools.product(left.items(), right.items())
                if similar(a, b, measure) and similar(a, b, measure) >= at_least - 1e-9}
        assert got == want and got
    least = {i: rng.choice([0.2, 0.5, 0.9]) for i in left}
    rows = J.similar_sets(frame(spark, left, "left_id", least), frame(spark, right, "right_id"), measure=measure).collect()
    want = {(i, j) for (i, a), (j, b) in itertools.product(left.items(), right.items())
            if similar(a, b, measure) and similar(a, b, measure) >= least[i] - 1e-9}
    assert sorted((r.left_id, r.right_id) for r in rows) == sorted(want)


def test_hot_tokens_make_few_candidates(spark):
    rng = random.Random(4)
    rows = {i: ["hot", "warm", *{f"r{rng.randint(0, 400)}" for _ in range(6)}] for i in range(300)}
    left, right = frame(spark, rows, "left_id"), frame(spark, rows, "right_id")
    assert J.candidates(left, right, 0.8).count() < 3000 < 300 * 300 / 4  # all 90,000 pairs share the hot tokens
    assert J.similar_sets(left, right, 0.8).where("left_id = right_id").count() == 300
    with pytest.raises(ValueError):
        J.similar_sets(left, right, 1.5)
    with pytest.raises(ValueError):
        J.similar_sets(left, right, 0.5, "overlap")
    nothing = frame(spark, {1: []}, "left_id")
    assert J.similar_sets(nothing, right, 0.5).count() == 0 and J.similar_sets(left, right.limit(0), 0.5).count() == 0


def test_bags(spark):
    rows = spark.createDataFrame([("abca",), ("",), ("é\U0001f600é",)], "s string")
    assert [r[0] for r in rows.select(J.bag(F.col("s"))).collect()] == [["a1", "b1", "c1", "a2"], [], ["é1", "\U0001f6001", "é2"]]


def spoken(rng, n):
    parts = ["met", "for", "min", "pril", "statin", "zole", "tor", "semide", "hydro", "xa", "li", "so", "ph", "kn"]
    return sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)})


def all_scores(spark, spans, terms):
    """Every pair scored by the definitions; the sound codes come from the engine and have tests of their own."""
    words = spark.createDataFrame([(w,) for w in {*spans, *terms}], "w string")
    code = {r[0]: r[1] for r in words.select("w", X.metaphone(F.col("w"))).collect()}
    out = {}
    for s, t in itertools.product(spans, terms):
        phonetic = brute.ratio(code[s], code[t]) if code[s] and code[t] else 0.0
        one = brute.cosine(s, t), brute.ratio(s.lower(), t.lower()), phonetic
        out[s, t] = (*one, 0.5 * one[0] + 0.3 * one[1] + 0.2 * one[2])
    return out


@pytest.mark.parametrize("k, terms", [(3, 60), (5, 4)])
def test_rankings_equal_brute_force(spark, k, terms):
    rng = random.Random(k)
    spans, vocabulary = spoken(rng, 40) + ["zz", "Q", "qq qq"], spoken(rng, terms)
    scores = all_scores(spark, spans, vocabulary)
    index = V.build_index(spark.createDataFrame([(t,) for t in vocabulary], "term string")).cache()
    table = spark.createDataFrame([(s,) for s in spans], "span string")
    order = lambda s: lambda t: (-round(scores[s, t][3], 9), -round(scores[s, t][0], 9), t)

    def rows(df):
        return {(r.span, r["rank"]): (r.term, round(r.final_score, 9)) for r in df.collect()}

    def want(nearest):
        return {(s, i + 1): (t, round(scores[s, t][3], 9)) for s in spans for i, t in enumerate(sorted(nearest(s), key=order(s)))}

    by_meaning = rows(V.rank_candidates(table, index, k))
    assert by_meaning == want(lambda s: sorted(vocabulary, key=lambda t: (-round(scores[s, t][0], 9), t))[:k])
    assert Counter(s for s, _ in by_meaning) == Counter({s: min(k, len(vocabulary)) for s in spans})
    assert rows(V.rank_by_all(table, index, k)) == want(lambda s: sorted(vocabulary, key=order(s))[:k])
    for threshold in (0.2, 0.45, 0.7, 1.0):
        got = {r.span: (r.term, round(r.final_score, 9)) for r in V.best_by_all(table, index, threshold).collect()}
        best = {s: min(vocabulary, key=order(s)) for s in spans}
        assert got == {s: (t, round(scores[s, t][3], 9)) for s, t in best.items()
                       if scores[s, t][3] >= threshold and s.lower() != t.lower()}
    with pytest.raises(ValueError):
        V.best_by_all(table, index, 0.0)
