import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from earshot.functions import entities as E
from earshot.functions import similarity as X
from earshot.operators import correction as K
from earshot.operators import gate as G
from earshot.operators import retrieval as V
from earshot.operators import spans as P

# Published gate training rows: three scores, word count, stopword, digit, label.
# The published training rows and scores.
TRAINING = [
    (0.91, 0.91, 1.0, 1, 0, 0, 1), (0.88, 0.42, 0.93, 3, 0, 0, 1), (0.84, 0.78, 0.88, 1, 0, 0, 1),
    (0.83, 0.55, 0.92, 2, 0, 0, 1), (0.79, 0.31, 0.74, 4, 0, 0, 1), (0.77, 0.44, 0.81, 1, 0, 0, 1),
    (0.83, 0.74, 0.80, 2, 0, 0, 0), (0.78, 0.86, 0.95, 2, 1, 0, 0), (0.77, 0.80, 0.88, 2, 1, 0, 0),
    (0.75, 0.76, 0.82, 3, 1, 0, 0), (0.76, 0.79, 0.85, 2, 1, 0, 0), (0.75, 0.77, 0.84, 3, 1, 0, 0),
    (0.99, 1.0, 1.0, 1, 0, 0, 0), (0.99, 1.0, 1.0, 1, 0, 0, 0), (0.99, 1.0, 1.0, 1, 0, 0, 0),
    (0.99, 1.0, 1.0, 1, 0, 0, 0),
]
TRAINING_COLUMNS = ", ".join(
    f"{n} {'double' if i < 3 else 'int'}" for i, n in enumerate([*G.FEATURE_NAMES, "should_correct"])
)


@pytest.fixture(scope="module")
def index(spark):
    terms = spark.createDataFrame([(t,) for t in E.MEDICATION_VOCABULARY], "term string")
    return V.build_index(terms).cache()


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_ratio_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["", "a", "metformin", "met forman", "x" * 70, "ab" * 40] + [
        "".join(rng.choice("abcde") for _ in range(rng.randint(1, 75))) for _ in range(25)
    ]
    rows = list(itertools.product(words, words))
    got = values(spark, rows, "a string, b string", X.ratio(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [brute.ratio(a, b) for a, b in rows]


def test_table_and_bits_agree(spark):
    rows = [("kitten", "sitting"), ("abcabba", "cbabac")]
    got = values(
        spark, rows, "a string, b string",
        X._lcs_table(F.col("a"), F.col("b")), X.lcs_by_masks(X.letter_masks(F.col("a")), F.length("a"), F.col("b")),
    )
    assert got == [(4, 4), (4, 4)]


# Published scores of mis-heard spans: letters, sound.
GOLDEN = [
    ("hydroxylzene", "hydroxyzine", 0.8695652173913043, 0.9333333333333332),
    ("patient needs metformin", "metformin", 0.5625, 0.5714285714285714),
    ("taking insulin and", "insulin", 0.56, 0.5263157894736842),
    ("taking amlodipine", "amlodipine", 0.7407407407407408, 0.7058823529411765),
    ("is taking metformin", "metformin", 0.6428571428571428, 0.6),
]


def test_golden_scores(spark):
    got = values(
        spark, [g[:2] for g in GOLDEN], "a string, b string",
        X.fuzzy_ratio(F.col("a"), F.col("b")), X.phonetic_ratio(F.col("a"), F.col("b")),
    )
    for (fuzzy, sound), (_, _, want_fuzzy, want_sound) in zip(got, GOLDEN):
        assert fuzzy == pytest.approx(want_fuzzy) and sound == pytest.approx(want_sound)


def test_golden_final_score(spark):
    final = spark.range(1).select(V.final_score(F.lit(0.6712580919265747), F.lit(0.8695652173913043), F.lit(0.9333333333333332)))
    assert round(final.first()[0], 4) == 0.7832


@pytest.mark.parametrize(
    "word, code",
    [("thumb", "0M"), ("knight", "NT"), ("phone", "FN"), ("school", "SKL"), ("science", "SNS"), ("edge", "EJ"),
     ("xylophone", "SLFN"), ("nation", "NXN"), ("which", "WX"), ("", ""), ("123", "")],
)
def test_metaphone(spark, word, code):
    assert values(spark, [(word,)], "w string", X.metaphone(F.col("w")))[0][0] == code


def test_ranking_equals_brute_force(spark, index):
    spans = ["hydroxylzene", "omeprazol", "less in april", "met forman", "statin", "zzz", "taking insulin"]
    df = spark.createDataFrame([(s,) for s in spans], "span string")
    near = {}
    for r in V.retrieve(df, index, 3).collect():
        near.setdefault(r["span"], []).append((r["term"], r["semantic_score"]))
    for span in spans:
        want = sorted(
            ((t, brute.cosine(span, t)) for t in E.MEDICATION_VOCABULARY if brute.grams(span) & brute.grams(t)),
            key=lambda x: (-x[1], x[0]),
        )[:3]
        got = sorted(near.get(span, []), key=lambda x: (-x[1], x[0]))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_semantic_topk_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_TERMS", 7)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(12, 4)), rng.normal(size=(20, 4))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    terms = spark.createDataFrame([(f"t{i:02d}", v.tolist()) for i, v in enumerate(t)], "term string, embedding array<double>")
    got = {(r["query_id"], r["place"]): r["term"] for r in V.semantic_topk(queries, terms, 3).collect()}
    order = np.argsort(-(q @ t.T), axis=1)
    assert got == {(i, p + 1): f"t{order[i, p]:02d}" for i in range(12) for p in range(3)}


def test_spans_and_forms(spark):
    df = spark.createDataFrame([(1, "The 12 patient needs Metfor-min!"), (2, ""), (3, None)], "id int, t string")
    runs = {(r["start"], r["end"]): r["span"] for r in P.explode_ngrams(df, "id", "t").collect()}
    assert len(runs) == 5 + 4 + 3 + 2 and runs[(1, 3)] == "12 patient"
    forms = {(r["start"], r["end"]): r["form"] for r in P.candidate_spans(df, "id", "t").collect()}
    assert forms[(4, 5)] == "metformin" and forms[(3, 5)] == "needs metformin" and (2, 5) not in forms


def test_reach_loses_nothing(spark, index):
    rng = random.Random(5)
    words = ["hydroxylzene", "omeprazol", "the", "of", "5", "met", "forman", "atorva", "statin", "torsemid", "insuline", "ing", "a"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(40)]
    df = spark.createDataFrame(texts, "id int, t string")
    every = K.proposals(P.candidate_spans(df, "id", "t"), index, None)
    reached = K.proposals(P.candidate_spans(df, "id", "t", reach=V.reach(index)), index, None)
    pick = lambda x: {(r["form"], r["proposal"]["candidate"]) for r in x.collect()}
    assert pick(every) == pick(reached) and len(pick(every)) > 5


def test_thresholds_that_letters_alone_can_reach_are_refused(spark, index):
    spans = spark.createDataFrame([("aabbccddeeff",)], "span string")
    with pytest.raises(ValueError, match="above"):
        V.best_candidates(spans, index, threshold=0.3)


def test_select_spans_is_greedy_and_disjoint(spark):
    rng = random.Random(11)
    rows = []
    for i in range(30):
        starts = [rng.randint(0, 20) for _ in range(rng.randint(1, 25))]
        rows.append((i, [(s, s + rng.randint(1, 4)) for s in starts]))
    df = spark.createDataFrame(rows, "id int, hits array<struct<start:int,end:int>>")
    got = {r["id"]: [(h["start"], h["end"]) for h in r["c"]] for r in df.select("id", P.select_spans(F.col("hits")).alias("c")).collect()}
    for i, hits in rows:
        kept = []
        for s, e in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(e <= a or b <= s for a, b in kept):
                kept.append((s, e))
        assert got[i] == kept


def test_select_spans_of_a_long_transcript(spark):
    """80,000 hits of one transcript are chosen in one pass; equal spans go by what else they hold; none give none."""
    runs = [(5 * i, 5 * i + j, f"c{k}") for i in range(10_000) for j in (1, 2, 3, 4) for k in (1, 0)]
    df = spark.createDataFrame([(1, runs), (2, []), (3, None)], "id int, hits array<struct<start:int,end:int,candidate:string>>")
    begun = time.time()
    got = {r["id"]: r["c"] for r in df.select("id", P.select_spans(F.col("hits")).alias("c")).collect()}
    assert time.time() - begun < 15
    assert [tuple(h) for h in got[1]] == [(5 * i, 5 * i + 4, "c0") for i in range(10_000)]
    assert got[2] == [] and got[3] is None


def test_runs_by_their_first_word(spark):
    df = spark.createDataFrame([(1, "Keep taking it keep"), (2, ""), (3, None), (4, "x y")], "id int, t string")
    test = lambda w: F.startswith(F.lower(w), F.lit("keep"))
    some = P.explode_ngrams(df, "id", "t", starting=test)
    every = P.explode_ngrams(df, "id", "t").where(test(F.col("span")))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) and some.count() == 5


def test_choice_and_rewrite_of_whole_documents(spark):
    """The registered queries over the smallest tables, beside brute force."""
    from earshot.plans import catalog
    from earshot.plans import queries_correction as Q

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in Q.heard(spark, sf_dir).collect()}
    picked = {}
    for r in catalog.QUERIES["select_spans"](spark, sf_dir).collect():
        picked.setdefault(r["doc_id"], set()).add((r["start"], r["end"], r["candidate"]))
    written = {r["doc_id"]: r["text"] for r in catalog.QUERIES["apply_corrections"](spark, sf_dir).collect()}
    assert set(written) == set(texts) and picked
    for doc_id, text in texts.items():
        words = text.split()
        hits = [(s, e, " ".join(words[s:e]).upper()) for s in range(len(words)) for e in range(s + 1, min(s + 4, len(words)) + 1)
                if " ".join(words[s:e]).lower().startswith(tuple(Q._HIT_STEMS))]
        kept = brute.chosen(hits)
        assert picked.get(doc_id, set()) == set(kept)
        assert written[doc_id] == brute.rewritten(words, kept)


@pytest.mark.parametrize("gated", [False, True])
def test_correction_equals_brute_force(spark, index, gated):
    rng = random.Random(17)
    words = [
        "patient", "needs", "the", "hydroxylzene", "5", "mg", "omeprazol.", "keep", "taking", "insulin", "and",
        "less", "in", "april", "atorvastaten", "torsemid,", "Metforman", "is", "rash",
    ]
    texts = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(25)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    gate = G.DEFAULT if gated else None
    got = {r["id"]: r for r in K.correct(df, index, "id", "t", gate).collect()}

    forms = {r["form"] for r in P.candidate_spans(df, "id", "t").select("form").distinct().collect()}
    names = sorted(forms | set(E.MEDICATION_VOCABULARY))
    coded = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.metaphone(F.col("n")).alias("c"))
    code = {r["n"]: r["c"] for r in coded.collect()}

    def choose(form):
        term = brute.best(form, E.MEDICATION_VOCABULARY, code, 0.70)
        if term is None or not gated:
            return term
        a, b = code[form], code[term]
        record = (
            brute.cosine(form, term), brute.ratio(form, term), brute.ratio(a, b) if a and b else 0.0,
            len(form.split()), int(any(w in G.STOPWORDS for w in form.split())), 0,
        )
        z = G.DEFAULT.intercept + sum(
            (x - m) / s * w for x, m, s, w in zip(record, G.DEFAULT.mean, G.DEFAULT.scale, G.DEFAULT.weight)
        )
        return term if 1 / (1 + np.exp(-z)) >= 0.55 else None

    total = 0
    for i, text in texts:
        want, applied = brute.correct(text or "", choose, set(P.COMMON_WORDS))
        assert got[i]["corrected_text"] == want
        assert len(got[i]["corrections"]) == applied
        total += applied
    assert total > 10
    lost = [r for r in got.values() if r["digits_lost"]]
    assert all(any(ch.isdigit() for c in r["corrections"] for ch in c["original"]) for r in lost)


def test_one_search_serves_both_gates(spark, index):
    from earshot.operators import evaluation as N

    rng = random.Random(3)
    words = ["patient", "hydroxylzene", "5", "omeprazol.", "keep", "less", "in", "april", "atorvastaten", "torsemid", "rash", "the"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)), ["metformin"], ["5"], []) for i in range(20)] + [(98, "", [], [], []), (99, None, [], [], [])]
    df = spark.createDataFrame(rows, "sample_id int, text string, target_keywords array<string>, target_numerics array<string>, target_negations array<string>")
    both = {r["sample_id"]: r for r in K.correct_both(df, index, "sample_id", "text").collect()}
    for name, gate in (("ungated", None), ("gated", G.DEFAULT)):
        alone = {r["sample_id"]: r for r in K.correct(df, index, "sample_id", "text", gate).collect()}
        for i, r in both.items():
            assert r[f"{name}_text"] == alone[i]["corrected_text"] and r[f"{name}_corrections"] == alone[i]["corrections"]
    truth = df.select("sample_id", F.lit("patient hydroxyzine 5").alias("reference_transcript")).where("sample_id <> 3")
    scored = N.evaluate_baselines(df, truth, index)
    records = {r["sample_id"]: r for r in N.nested_records(scored).collect()}
    assert set(records) == set(both) - {3}
    assert records[0]["baseline_0_raw"]["hypothesis"] == rows[0][1] and records[0]["reference"] == "patient hydroxyzine 5"
    assert set(records[0]["baseline_0_raw"].asDict()) == {"wer", "cer", "keyword_acc", "numeric_acc", "negation_acc", "hypothesis"}
    assert records[0]["baseline_2_corrections"] == both[0]["ungated_corrections"]
    assert records[0]["baseline_3_corrections"] == both[0]["gated_corrections"]
    assert records[0]["baseline_2_retrieval"]["hypothesis"] == both[0]["ungated_text"]
    assert records[98]["baseline_3_gated_retrieval"]["wer"] == 1.0


def test_large_lookups_take_the_salted_join(spark, index, monkeypatch):
    df = spark.createDataFrame([(i, "patient hydroxylzene 5 mg omeprazol.") for i in range(20)], "id int, t string")
    small = {(r["id"], r["corrected_text"]) for r in K.correct(df, index, "id", "t").collect()}
    monkeypatch.setattr(K, "written_lookup", lambda table: (table, False))
    assert {(r["id"], r["corrected_text"]) for r in K.correct(df, index, "id", "t").collect()} == small


def test_correction_can_be_off(spark, index):
    df = spark.createDataFrame([(1, "a  hydroxylzene")], "id int, t string")
    row = K.correct(df, index, "id", "t", enabled=False).first()
    assert row["corrected_text"] == "a  hydroxylzene" and row["corrections"] == []


def test_word_fuzzy(spark):
    texts = [(1, "takes hydroxylzene and Metformin now"), (2, "omeprazol, insulinn"), (3, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    got = {r["id"]: r for r in K.word_fuzzy_correct(df, "id", "t").collect()}
    for i, text in texts:
        words = []
        for w in text.split():
            score, _, term = max((brute.ratio(w, t), -n, t) for n, t in enumerate(K.WORD_LIST))
            words.append(term if score >= 0.85 and w.lower() != term else w)
        assert got[i]["corrected_text"] == " ".join(words)
    assert got[1]["word_corrections"][0]["original"] == "hydroxylzene"


def test_highlight(spark):
    got = values(spark, [("Take the Dose now", ["dose", "none", "take"])], "t string, c array<string>", P.highlight_spans(F.col("t"), F.col("c")))
    assert [(p["part"], p["highlighted"]) for p in got[0][0]] == [("Take", True), (" the ", False), ("Dose", True), (" now", False)]


def test_logistic_gate_matches_the_published_one(spark):
    model = G.fit_logistic(spark.createDataFrame(TRAINING, TRAINING_COLUMNS))
    fitted = G.coefficients(model)
    assert fitted.weight == pytest.approx(G.DEFAULT.weight, abs=1e-4)
    assert fitted.intercept == pytest.approx(G.DEFAULT.intercept, abs=1e-4)
    golden = spark.createDataFrame(
        [(0.6712580919265747, 0.8695652173913043, 0.9333333333333332, 1, 0, 0)],
        TRAINING_COLUMNS.rsplit(",", 1)[0],
    ).withColumn("features", F.struct(*G.FEATURE_NAMES))
    assert G.predict_proba(model, golden).first()["gate_probability"] == pytest.approx(0.7228, abs=2e-4)
    assert golden.select(G.DEFAULT.probability(F.col("features"))).first()[0] == pytest.approx(0.7228, abs=1e-4)


def test_gate_save_load_and_trees(spark, tmp_path):
    training = spark.createDataFrame(TRAINING, TRAINING_COLUMNS)
    rows = training.withColumn("features", F.struct(*G.FEATURE_NAMES))
    model = G.fit_logistic(training)
    G.save(model, str(tmp_path / "gate"))
    before = [r["gate_probability"] for r in G.predict_proba(model, rows).collect()]
    after = [r["gate_probability"] for r in G.predict_proba(G.load(str(tmp_path / "gate")), rows).collect()]
    assert before == after
    trees = G.fit_trees(training, rounds=5)
    kept = G.gate_filter(rows, trees).select("should_correct").collect()
    assert [r[0] for r in kept] == [1] * 6


def test_reach_knows_the_terms_apart(spark, index):
    """Words that share trigrams with several terms, but few with each, are not looked up."""
    reach = V.reach(index)
    df = spark.createDataFrame([(1, "amlosarpril  métforman metinsulol taking metforman"), (2, None), (3, "")], "id int, t string")
    forms = {r["form"] for r in P.candidate_spans(df, "id", "t", reach=reach).collect()}
    every = {r["form"] for r in P.candidate_spans(df, "id", "t").collect()}
    assert "amlosarpril" in every and "amlosarpril" not in forms
    assert "metforman" in forms and forms < every


def test_reach_of_many_terms_loses_nothing(spark):
    """Beyond the number of groups, terms share them by hash."""
    rng = random.Random(3)
    terms = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    index = V.build_index(spark.createDataFrame([(t,) for t in terms], "term string"))
    heard = [t[:3] + rng.choice("aeiou") + t[4:] for t in terms] + [t[:4] + " " + t[4:] for t in terms]
    df = spark.createDataFrame([(i, " x ".join(heard[i::10])) for i in range(10)], "id int, t string")
    every = K.proposals(P.candidate_spans(df, "id", "t"), index, None)
    reached = K.proposals(P.candidate_spans(df, "id", "t", reach=V.reach(index)), index, None)
    assert sorted(map(str, reached.collect())) == sorted(map(str, every.collect())) and every.count() > 100


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_places_equal_the_whole_sort(k):
    scores = np.random.default_rng(5).integers(0, 6, (40, 30)).astype(float)
    scores[3, 4] = np.nan
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rows, columns = V.best_places(scores, k)
    assert rows.tolist() == np.repeat(np.arange(40), top.shape[1]).tolist()
    assert columns.tolist() == top.ravel().tolist()


def test_forms_are_ranked_by_all_cores(spark, index):
    """Rows of forms are small and their ranking is not: adaptive execution must not join their partitions."""
    forms = spark.createDataFrame([("metforman",)], "form string")
    plan = K.proposals(forms, index)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
