"""Large lexicons beside a test of every term."""

import random

import pytest

from earshot.operators import lexicon as L


@pytest.mark.parametrize("limit", [L.SLICE_BYTES, 600])
def test_terms_equal_a_test_of_each(spark, limit):
    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 5)))
    terms = [word() for _ in range(300)] + [None, "", "Upper", "upper"]
    texts = [(i, rng.choice(["", None, " ".join(word() for _ in range(30)), "an UPPER case"])) for i in range(60)]
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.id: r.terms for r in L.lexicon_terms(spark.createDataFrame(texts, "id long, text string"), "id", "text", lexicon, limit=limit).collect()}
    known = {t.lower() for t in terms if t}
    assert got == {i: sorted(t for t in known if t in (text or "").lower()) for i, text in texts}
    assert (L.lexicon_slices(lexicon, limit=limit)[1] > 3) == (limit == 600)


def test_a_hundred_thousand_terms(spark):
    lexicon = spark.range(100_000).selectExpr("concat('term', lpad(id, 6, '0'), 'x') AS term")
    texts = spark.createDataFrame([(1, "a Term000017x and term099999x"), (2, "term17x")], "id long, text string")
    got = {r.id: r.terms for r in L.lexicon_terms(texts, "id", "text", lexicon).collect()}
    assert got == {1: ["term000017x", "term099999x"], 2: []}
    assert L.lexicon_terms(texts, "id", "text", lexicon.limit(0)).where("size(terms) = 0").count() == 2
