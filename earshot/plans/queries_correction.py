"""Registered queries: spans, similarity, retrieval, gate and correction over whole transcripts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import entities as E
from earshot.functions import similarity as X
from earshot.functions.text import let, normalize, tokens
from earshot.operators import correction as K
from earshot.operators import evaluation as N
from earshot.operators import gate as G
from earshot.operators import lexicon as L
from earshot.operators import reports as R
from earshot.operators import retrieval as V
from earshot.operators import scoring as S
from earshot.operators import spans as P
from earshot.operators import vector_index as I
from earshot.operators.setjoin import similar_sets
from earshot.plans import corpus as C
from earshot.plans.queries_metrics import sql_strings, sql_words, with_targets
from earshot.plans.queries_text import sql_normalize
from earshot.plans.registry import query
from earshot.schemas import GATE_TRAINING
from earshot.session import fresh_path, via_table
from earshot.sources import files


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in E.MEDICATION_VOCABULARY], "term string")


def index(spark: SparkSession) -> DataFrame:
    return V.build_index(vocabulary(spark))


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.misheard(spark, sf_dir).select("doc_id", "text")


# Spans in SQL: all runs of 1..4 words of every transcript.
NGRAMS = f"""{C.MISHEARD}, ws AS (SELECT doc_id, {sql_words('text')} AS w FROM misheard),
runs AS (SELECT doc_id, i AS start, i + j AS "end", array_to_string(w[i + 1 : i + j], ' ') AS span
  FROM ws, unnest(range(0, len(w))) AS a(i), unnest([1, 2, 3, 4]) AS b(j) WHERE i + j <= len(w)),
cleaned AS (SELECT *, trim(regexp_replace(span, '[^a-zA-Z ]', '', 'g')) AS clean FROM runs),
judged AS (SELECT *, length(replace(clean, ' ', '')) >= 6 AS long_enough,
  list_filter(string_split(lower(clean), ' '), lambda x: x <> '') AS cw FROM cleaned),
scored_spans AS (SELECT *, CASE WHEN len(cw) = 0 THEN 0.0 ELSE
  len(list_filter(cw, lambda x: NOT list_contains({sql_strings(P.COMMON_WORDS)}, x))) / len(cw) END AS suspicious FROM judged),
candidates AS (SELECT doc_id, start, "end", span, clean, lower(clean) AS form FROM scored_spans
  WHERE long_enough AND suspicious >= 0.5)"""


@query("ngrams", f'WITH {NGRAMS} SELECT doc_id, start, "end", span FROM runs')
def q_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.explode_ngrams(heard(spark, sf_dir), "doc_id", "text")


def _word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance as one span."""
    return C.utterances(spark, sf_dir).select(
        "doc_id", "utt", P.clean_span(C.replace_all(F.col("reference_text"), C.RAW_ERRORS)).alias("clean")
    )


_UTTERANCE_SPANS = rf"""{C.UTTERANCES}, spans AS (SELECT doc_id, utt,
  trim(regexp_replace({C.sql_replace_all('reference_text', C.RAW_ERRORS)}, '[^a-zA-Z ]', '', 'g')) AS clean FROM utterances),
cw AS (SELECT *, list_filter(string_split(lower(clean), ' '), lambda x: x <> '') AS w FROM spans)"""


@query("clean_span", f"WITH {_UTTERANCE_SPANS} SELECT doc_id, utt, clean FROM cw")
def q_clean_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_spans(spark, sf_dir)


@query("looks_like_error", f"WITH {_UTTERANCE_SPANS} SELECT doc_id, utt, length(replace(clean, ' ', '')) >= 6 AS likely FROM cw")
def q_looks_like_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_spans(spark, sf_dir).select("doc_id", "utt", P.looks_like_error(F.col("clean")).alias("likely"))


@query(
    "suspicious_score",
    f"""WITH {_UTTERANCE_SPANS} SELECT doc_id, utt, CASE WHEN len(w) = 0 THEN 0.0 ELSE
        len(list_filter(w, lambda x: NOT list_contains({sql_strings(P.COMMON_WORDS)}, x))) / len(w) END AS suspicious FROM cw""",
)
def q_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_spans(spark, sf_dir).select("doc_id", "utt", P.suspicious_score(F.col("clean")).alias("suspicious"))


@query("candidate_spans", f'WITH {NGRAMS} SELECT doc_id, start, "end", form FROM candidates')
def q_candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_spans(heard(spark, sf_dir), "doc_id", "text")


# Retrieval. The vocabulary of the index queries is every distinct word of the benchmark items.

_ITEM_WORDS = f"""SELECT DISTINCT lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) AS term
  FROM (SELECT unnest({sql_words('text')}) AS w FROM benchmark)"""
GRAMS = """padded AS (SELECT {0} AS text, concat(' ', lower({0}), ' ') AS p FROM {1}),
grams_of AS (SELECT text, list_distinct(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: p[i : i + 2])) AS g FROM padded)"""


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = C.table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("w"))
    term = F.lower(F.regexp_replace("w", "[^a-zA-Z]", "")).alias("term")
    return words.select(term).where(F.col("term") != "").distinct()


@query(
    "build_index",
    f"""WITH terms AS (SELECT * FROM ({_ITEM_WORDS}) WHERE term <> ''), {GRAMS.format('term', 'terms')}
        SELECT text AS term, len(g) AS grams, round(1 / sqrt(len(g)), 9) AS weight, unnest(g) AS gram FROM grams_of""",
)
def q_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build_index(item_words(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


_TOPK_SQL = """WITH scored AS (
  SELECT q.vec_id AS query_id, t.vec_id AS term_id,
         list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * t.embedding[i]::DOUBLE)) AS s
  FROM embeddings q, embeddings t)
SELECT query_id, term_id, place, round(s, 6) AS semantic_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, term_id) AS place FROM scored) WHERE place <= 3"""


@query(
    "lexicon_terms",
    f"""WITH {C.MISHEARD}, terms AS (SELECT * FROM ({_ITEM_WORDS}) WHERE term <> ''),
        found AS (SELECT doc_id, term FROM misheard JOIN terms ON contains(lower(text), term))
        SELECT m.doc_id, count(term) AS n_terms, coalesce(string_agg(term, '|' ORDER BY term), '') AS terms
        FROM misheard m LEFT JOIN found f ON m.doc_id = f.doc_id GROUP BY m.doc_id""",
)
def q_lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark items as one large lexicon, looked up in every transcript."""
    found = L.lexicon_terms(heard(spark, sf_dir), "doc_id", "text", item_words(spark, sf_dir))
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@query("semantic_topk", _TOPK_SQL)
def q_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    terms = vectors.select(F.col("vec_id").alias("term_id"), "embedding")
    top = V.semantic_topk(queries, terms, 3, "query_id", "term_id")
    return top.withColumn("semantic_score", F.round("semantic_score", 6))


@query("approximate_topk")
def q_approximate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against a stored index of all of them, by its nearest cells. What it finds is scored exactly."""
    vectors = C.table(spark, sf_dir, "embeddings")
    stored = I.write_vector_index(vectors.select(F.col("vec_id").alias("term_id"), "embedding"), fresh_path(spark, "vectors"), "term_id")
    top = I.approximate_topk(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), stored, 3)
    return top.withColumn("semantic_score", F.round("semantic_score", 6))


@query(
    "normalize_vectors",
    """WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
       SELECT vec_id, i - 1 AS pos, round(CASE WHEN norm = 0 THEN e[i]::DOUBLE ELSE e[i]::DOUBLE / norm END, 8) AS value
       FROM n, unnest(range(1, len(e) + 1)) AS t(i)""",
)
def q_normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = V.normalized(F.col("embedding").cast("array<double>"))
    return C.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode_outer(unit).alias("pos", "value")
    ).withColumn("value", F.round("value", 8))


# Distinct words of all transcripts against the term each shares most trigrams with.
_DOC_WORDS = f"""{C.MISHEARD}, words AS (SELECT DISTINCT lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) AS word
  FROM (SELECT unnest({sql_words('text')}) AS w FROM misheard))"""
_RETRIEVED = f"""{_DOC_WORDS}, terms AS (SELECT unnest({sql_strings(E.MEDICATION_VOCABULARY)}) AS term),
wp AS (SELECT word, concat(' ', word, ' ') AS p FROM words WHERE word <> ''),
wg AS (SELECT word, list_distinct(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: p[i : i + 2])) AS g FROM wp),
tp AS (SELECT term, concat(' ', term, ' ') AS p FROM terms),
tg AS (SELECT term, list_distinct(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: p[i : i + 2])) AS g FROM tp),
wr AS (SELECT word, len(g) AS n, unnest(g) AS gram FROM wg), tr AS (SELECT term, len(g) AS m, unnest(g) AS gram FROM tg),
pairs AS (SELECT word AS span, term, count(*) / sqrt(any_value(n) * any_value(m)) AS semantic FROM wr JOIN tr USING (gram) GROUP BY word, term),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY semantic DESC, term) AS place FROM pairs) WHERE place <= 3)"""


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = heard(spark, sf_dir).select(F.explode_outer(tokens(F.col("text"))).alias("w"))
    form = F.lower(F.regexp_replace("w", "[^a-zA-Z]", "")).alias("span")
    return words.select(form).where(F.col("span") != "").distinct()


@query("retrieve", f"WITH {_RETRIEVED} SELECT span, term, round(semantic, 9) AS semantic_score FROM near")
def q_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = V.retrieve(doc_words(spark, sf_dir), index(spark), 3)
    return near.withColumn("semantic_score", F.round("semantic_score", 9))


# The longest common subsequence in SQL: one table row per character of the
# span, each row a fold over the characters of the term.
LCS = """list_reduce({a}, lambda row, x: list_reduce(range(1, len({b}) + 1), lambda q, j: list_append(q,
    CASE WHEN {b}[j] = x THEN row[j]::INT + 1 ELSE greatest(row[j + 1]::INT, q[j]) END), [0]),
    list_transform(range(0, len({b}) + 1), lambda z: 0))[-1]""".format(a="a", b="b")


@query(
    "fuzzy_ratio",
    f"""WITH {_RETRIEVED}, cells AS (SELECT span, term, regexp_extract_all(span, '(?s).') AS a,
          regexp_extract_all(term, '(?s).') AS b FROM near)
        SELECT span, term, round(2 * {LCS} / (len(a) + len(b)), 9) AS fuzzy_score FROM cells""",
)
def q_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = V.retrieve(doc_words(spark, sf_dir), index(spark), 3)
    return near.select("span", "term", F.round(X.fuzzy_ratio(F.col("span"), F.col("term")), 9).alias("fuzzy_score"))


# The sound rules in SQL, whose patterns cannot look around: what stands around a match is matched and put back. Rules
# whose contexts can overlap are applied until chains of them are done.
_DOUBLED = [(f"{c}{c}+", c) for c in "abdefghijklmnopqrstuvwxyz"]
SQL_METAPHONE = [
    ("[^a-z ]", ""), ("(^|[^a-z])(?:a(e)|[gkp](n)|w(r))", r"\1\2\3\4"), ("(^|[^a-z])x", r"\1s"), ("(^|[^a-z])wh", r"\1w"),
    *_DOUBLED, ("mb([^a-z]|$)", r"m\1"), ("tch", "ch"), ("sch", "sK"), ("ch|c(ia)", r"X\1"), ("sc([iey])", r"s\1"),
    ("c([iey])", r"S\1"), ("ck?", "K"), ("dg([eiy])", r"J\1"), ("d", "T"), *[("g(h[^aeiou ])", r"\1")] * 2,
    ("g(n(?:ed)?(?:[^a-z]|$))", r"\1"), ("gh", "K"), ("g([iey])", r"J\1"), ("g", "K"), ("ph", "F"), ("sh|s(i[oa])", r"X\1"),
    ("t(i[oa])", r"X\1"), ("th", "0"), ("([aeiou])h([^aeiou]|$)", r"\1\2"), ("q", "K"), ("v", "F"), ("x", "KS"), ("z", "S"),
    *[("[wy]([^aeiou]|$)", r"\1")] * 4, ("([a-zA-Z0])[aeiou]+", r"\1"),
]


def sql_metaphone(expr: str) -> str:
    out = f"lower({expr})"
    for pattern, code in SQL_METAPHONE:
        out = f"regexp_replace({out}, '{pattern}', '{code}', 'g')"
    return f"trim(regexp_replace(upper({out}), ' +', ' ', 'g'))"


_CODED = f"""span_codes AS (SELECT word AS span, {sql_metaphone('word')} AS code_a FROM words WHERE word <> ''),
term_codes AS (SELECT term, {sql_metaphone('term')} AS code_b FROM terms)"""
# Scores of pairs ``near`` (span, term, semantic). The letters and the sounds go through the same fold.
_SCORED = f"""{_CODED}, spelled AS (SELECT span, term, semantic, regexp_extract_all(lower(span), '(?s).') AS a, regexp_extract_all(term, '(?s).') AS b,
  regexp_extract_all(code_a, '(?s).') AS ca, regexp_extract_all(code_b, '(?s).') AS cb FROM near JOIN span_codes USING (span) JOIN term_codes USING (term)),
three AS (SELECT span, term, semantic, 2 * {LCS} / (len(a) + len(b)) AS fuzzy,
  CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN 0 ELSE 2 * {LCS.replace('len(b)', 'len(cb)').replace('b[j]', 'cb[j]').replace('list_reduce(a,', 'list_reduce(ca,')} / (len(ca) + len(cb)) END AS phonetic FROM spelled),
final AS (SELECT *, {V.SEMANTIC_WEIGHT} * semantic + {V.FUZZY_WEIGHT} * fuzzy + {V.PHONETIC_WEIGHT} * phonetic AS score FROM three)"""


@query("phonetic_ratio", f"WITH {_RETRIEVED}, {_SCORED} SELECT span, term, round(phonetic, 9) AS phonetic_score FROM three")
def q_phonetic_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = V.retrieve(doc_words(spark, sf_dir), index(spark), 3)
    return near.select("span", "term", F.round(X.phonetic_ratio(F.col("span"), F.col("term")), 9).alias("phonetic_score"))


@query("metaphone", f"WITH {_DOC_WORDS} SELECT word AS span, {sql_metaphone('word')} AS code FROM words WHERE word <> ''")
def q_metaphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_words(spark, sf_dir).select("span", X.metaphone(F.col("span")).alias("code"))


# All terms of every span, those without a common trigram with score 0 and in the order of the terms.
_ALL_PAIRS = "{spans} CROSS JOIN terms LEFT JOIN pairs ON pairs.span = word AND pairs.term = terms.term"
_FILLED = f"""{_RETRIEVED.rpartition('near AS')[0]}
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY semantic DESC, term) AS place
  FROM (SELECT word AS span, terms.term AS term, coalesce(semantic, 0.0) AS semantic FROM {_ALL_PAIRS.format(spans='words')} WHERE word <> '')) WHERE place <= 3)"""
_RANKED_COLUMNS = """span, term, round(semantic, 9) AS semantic_score, round(fuzzy, 9) AS fuzzy_score,
  round(phonetic, 9) AS phonetic_score, round(score, 9) AS final_score"""
# Equal scores have to be equal in both engines' arithmetic, so they are ordered by their rounded values.
_BY_SCORE = "PARTITION BY span ORDER BY round(score, 9) DESC, round(semantic, 9) DESC, term"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("semantic_score", "fuzzy_score", "phonetic_score", "final_score")})


@query(
    "rank_candidates",
    f"WITH {_FILLED}, {_SCORED} SELECT {_RANKED_COLUMNS}, row_number() OVER ({_BY_SCORE}) AS rank FROM final",
)
def q_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.rank_candidates(doc_words(spark, sf_dir), index(spark), 3))


@query(
    "best_candidates",
    f"""WITH {_RETRIEVED}, {_SCORED}, best AS (SELECT *, row_number() OVER ({_BY_SCORE}) AS rank FROM final WHERE score >= {V.THRESHOLD})
        SELECT {_RANKED_COLUMNS} FROM best WHERE rank = 1 AND span <> term""",
)
def q_best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.best_candidates(doc_words(spark, sf_dir), index(spark)))


# Search by all three scores: every word of the benchmark items against every term.
_EVERY_PAIR = f"""words AS (SELECT term AS word FROM ({_ITEM_WORDS}) WHERE term <> ''), {_RETRIEVED[len(_DOC_WORDS) + 2:].rpartition('near AS')[0]}
near AS (SELECT word AS span, terms.term AS term, coalesce(semantic, 0.0) AS semantic FROM {_ALL_PAIRS.format(spans='words')})"""


@query(
    "rank_by_all",
    f"""WITH {_EVERY_PAIR}, {_SCORED}, ranked AS (SELECT *, row_number() OVER ({_BY_SCORE}) AS rank FROM final)
        SELECT {_RANKED_COLUMNS}, rank FROM ranked WHERE rank <= 3""",
)
def q_rank_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = item_words(spark, sf_dir).withColumnRenamed("term", "span")
    return _rounded(V.rank_by_all(spans, index(spark), 3))


@query(
    "best_by_all",
    f"""WITH {_EVERY_PAIR}, {_SCORED}, best AS (SELECT *, row_number() OVER ({_BY_SCORE}) AS rank FROM final WHERE score >= 0.35)
        SELECT {_RANKED_COLUMNS} FROM best WHERE rank = 1 AND span <> term""",
)
def q_best_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = item_words(spark, sf_dir).withColumnRenamed("term", "span")
    return _rounded(V.best_by_all(spans, index(spark), 0.35))


@query(
    "similar_words",
    f"""WITH {_DOC_WORDS}, terms AS (SELECT * FROM ({_ITEM_WORDS}) WHERE term <> ''),
        wg AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 1), lambda i: concat(' ', word, ' ')[i : i + 2])) AS g FROM words WHERE word <> ''),
        tg AS (SELECT term, list_distinct(list_transform(range(1, length(term) + 1), lambda i: concat(' ', term, ' ')[i : i + 2])) AS g FROM terms),
        wr AS (SELECT word, len(g) AS a, unnest(g) AS gram FROM wg), tr AS (SELECT term, len(g) AS b, unnest(g) AS gram FROM tg)
        SELECT word, term, count(*) AS shared, any_value(a) AS word_grams, any_value(b) AS term_grams
        FROM wr JOIN tr USING (gram) GROUP BY word, term HAVING count(*) >= 0.6 * sqrt(any_value(a) * any_value(b)) - 1e-9""",
)
def q_similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the transcripts with the words of the benchmark items whose trigrams are alike."""
    left = doc_words(spark, sf_dir).select(F.col("span").alias("left_id"), X.trigrams(F.col("span")).alias("tokens"))
    right = item_words(spark, sf_dir).select(F.col("term").alias("right_id"), X.trigrams(F.col("term")).alias("tokens"))
    return similar_sets(left, right, 0.6).select(
        F.col("left_id").alias("word"), F.col("right_id").alias("term"), F.col("shared").cast("long"),
        F.col("left_size").alias("word_grams"), F.col("right_size").alias("term_grams"))


# Gate. Feature rows are derived from the embeddings: three score-like numbers
# per vector, and flags from its id.
def _features(first: int) -> list[str]:
    """``first`` is the number of an array's first element in the dialect."""
    scores = [f"abs(embedding[{first + i}]) AS {name}" for i, name in enumerate(G.FEATURE_NAMES[:3])]
    flags = ["vec_id % 4 + 1 AS word_count", "CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS contains_stopword"]
    return [*scores, *flags, "0 AS contains_digit"]


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return vectors.selectExpr("vec_id", "label", *_features(0)).withColumn(
        "should_correct", (F.col("label") < 4).cast("int")
    )


def _sql_probability() -> str:
    terms = [
        f"(({name}) - ({m!r}::DOUBLE)) / ({s!r}::DOUBLE) * ({w!r}::DOUBLE)"
        for name, m, s, w in zip(G.FEATURE_NAMES, G.DEFAULT.mean, G.DEFAULT.scale, G.DEFAULT.weight)
    ]
    return f"1 / (1 + exp(-(({G.DEFAULT.intercept!r}::DOUBLE) + {' + '.join(terms)})))"


_SQL_FEATURES = f"""rows AS (SELECT vec_id, label, {', '.join(_features(1))}
  FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS embedding FROM embeddings))"""


@query(
    "gate_features",
    f"""WITH {_UTTERANCE_SPANS} SELECT doc_id, utt, len(w) AS word_count,
        CASE WHEN list_has_any(w, {sql_strings(G.STOPWORDS)}) THEN 1 ELSE 0 END AS contains_stopword,
        CASE WHEN regexp_matches(clean, '[0-9]') THEN 1 ELSE 0 END AS contains_digit FROM cw""",
)
def q_gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    record = G.features(F.col("clean"), zero, zero, zero)
    return _word_spans(spark, sf_dir).withColumn("f", record).select(
        "doc_id", "utt", "f.word_count", "f.contains_stopword", "f.contains_digit"
    )


@query(
    "gate_filter",
    f"""WITH {_SQL_FEATURES}, judged AS (SELECT vec_id, {_sql_probability()} AS p FROM rows)
        SELECT vec_id, round(p, 9) AS gate_probability FROM judged WHERE p >= 0.55""",
)
def q_gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir).withColumn("features", F.struct(*G.FEATURE_NAMES))
    return G.gate_filter(rows, G.DEFAULT).select("vec_id", F.round("gate_probability", 9).alias("gate_probability"))


@query("gate_logistic")
def q_gate_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic gate fitted, saved, loaded and applied to all feature rows."""
    rows = feature_rows(spark, sf_dir)
    path = fresh_path(spark, "gate")
    G.save(G.fit_logistic(rows), path)
    scored = G.predict_proba(G.load(path), rows.withColumn("features", F.struct(*G.FEATURE_NAMES)))
    return scored.select("vec_id", "should_correct", F.round("gate_probability", 6).alias("gate_probability"))


@query("gate_trees")
def q_gate_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted gate fitted on all feature rows, reported per class."""
    rows = feature_rows(spark, sf_dir)
    model = G.fit_trees(rows)
    scored = G.predict_proba(model, rows.withColumn("features", F.struct(*G.FEATURE_NAMES)))
    judged = scored.withColumn("predicted", (F.col("gate_probability") >= 0.5).cast("int"))
    return R.classification_report(judged, "should_correct", "predicted")


# Choice and rewrite. Hits are all runs that begin with a clinical stem, of any length and at any place.
_HIT_STEMS = ["met", "atorvastat", "hydroxy", "omepra", "torse", "taking", "keep"]


def _begins_hit(word: Column) -> Column:
    """A stem holds no blank, so a run begins with it where its first word does."""
    return let(F.lower(word), lambda w: reduce(or_, (F.startswith(w, F.lit(stem)) for stem in _HIT_STEMS)))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = P.explode_ngrams(heard(spark, sf_dir), "doc_id", "text", starting=_begins_hit)
    hit = F.struct("start", "end", F.upper("span").alias("candidate"))
    return runs.groupBy("doc_id").agg(F.collect_list(hit).alias("hits"))


def sql_chosen() -> str:
    """The choice in SQL, length by length: runs that a longer chosen one touches go, the others are taken from the left.

    Reads ``hits`` (doc_id, start, "end", ..) and makes ``chosen``.
    """
    parts, kept = [], []
    for n in (4, 3, 2, 1):
        taken = " UNION ALL ".join(f"SELECT doc_id, unnest(range(start, start + {m})) AS pos FROM kept_{m}" for m in kept)
        blocked = (f"""SELECT DISTINCT doc_id, start FROM (SELECT doc_id, start, unnest(range(start, start + {n})) AS pos
          FROM hits WHERE "end" - start = {n}) JOIN ({taken}) USING (doc_id, pos)""" if kept else "SELECT doc_id, start FROM hits WHERE false")
        parts.append(f"""kept_{n} AS (SELECT doc_id, start FROM (
          SELECT doc_id, unnest(list_reduce(list(start ORDER BY start), lambda acc, s: CASE WHEN s >= acc[-1] + {n} THEN list_append(acc, s) ELSE acc END, [-100::BIGINT])) AS start
          FROM (SELECT doc_id, start::BIGINT AS start FROM hits WHERE "end" - start = {n} EXCEPT SELECT doc_id, start FROM ({blocked})) GROUP BY doc_id) WHERE start >= 0)""")
        kept.append(n)
    together = " UNION ALL ".join(f'SELECT doc_id, start, start + {n} AS "end" FROM kept_{n}' for n in kept)
    return ", ".join([*parts, f'chosen AS (SELECT h.* FROM hits h JOIN ({together}) k ON h.doc_id = k.doc_id AND h.start = k.start AND h."end" = k."end")'])


# Every text rewritten: the first word of a chosen span becomes its candidate, the others go.
SQL_REWRITTEN = """covered AS (SELECT doc_id, start, unnest(range(start, "end")) AS pos, candidate FROM chosen),
placed AS (SELECT doc_id, i - 1 AS pos, w[i] AS word FROM ws, unnest(range(1, len(w) + 1)) AS t(i)),
rewritten AS (SELECT ws.doc_id, coalesce(e.text, '') AS text FROM ws LEFT JOIN (
  SELECT p.doc_id, string_agg(CASE WHEN c.doc_id IS NULL THEN word WHEN p.pos = c.start THEN candidate END, ' ' ORDER BY p.pos) AS text
  FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id) e ON ws.doc_id = e.doc_id)"""

_SQL_HITS = f"""{NGRAMS}, hits AS (SELECT doc_id, start, "end", upper(span) AS candidate FROM runs
  WHERE {' OR '.join(f"starts_with(lower(span), '{stem}')" for stem in _HIT_STEMS)})"""


@query("select_spans", f'WITH {_SQL_HITS}, {sql_chosen()} SELECT doc_id, start, "end", candidate FROM chosen')
def q_select_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _hits(spark, sf_dir).select("doc_id", F.inline(P.select_spans(F.col("hits"))))
    return chosen.select("doc_id", "start", "end", "candidate")


@query("apply_corrections", f"WITH {_SQL_HITS}, {sql_chosen()}, {SQL_REWRITTEN} SELECT doc_id, text FROM rewritten")
def q_apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = heard(spark, sf_dir)
    chosen = _hits(spark, sf_dir).select("doc_id", P.select_spans(F.col("hits")).alias("chosen"))
    return docs.join(chosen, "doc_id", "left").select(
        "doc_id", P.apply_corrections(tokens(F.col("text")), F.col("chosen")).alias("text")
    )


# The whole correction in SQL: forms of the candidate spans, their nearest terms, scores, gate, choice, rewrite. Pairs
# whose trigrams alone rule the threshold out go first, as the other two scores are at most 1.
_FLOOR = (V.THRESHOLD - V.FUZZY_WEIGHT - V.PHONETIC_WEIGHT) / V.SEMANTIC_WEIGHT
_FORM_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: concat(' ', {0}, ' ')[i : i + 2]))"
_JUDGED = f"""{NGRAMS}, terms AS (SELECT unnest({sql_strings(E.MEDICATION_VOCABULARY)}) AS term),
words AS (SELECT DISTINCT form AS word FROM candidates),
fr AS (SELECT word, len(g) AS n, unnest(g) AS gram FROM (SELECT word, {_FORM_GRAMS.format('word')} AS g FROM words)),
tr AS (SELECT term, len(g) AS m, unnest(g) AS gram FROM (SELECT term, {_FORM_GRAMS.format('term')} AS g FROM terms)),
pairs AS (SELECT word AS span, term, count(*) / sqrt(any_value(n) * any_value(m)) AS semantic FROM fr JOIN tr USING (gram)
  GROUP BY word, term HAVING count(*) / sqrt(any_value(n) * any_value(m)) >= {_FLOOR} - 1e-9),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY semantic DESC, term) AS place FROM pairs) WHERE place <= 3),
{_SCORED.replace("FROM words WHERE word <> ''", "FROM words WHERE word IN (SELECT span FROM near)")},
best AS (SELECT *, row_number() OVER ({_BY_SCORE}) AS rank FROM final WHERE score >= {V.THRESHOLD}),
features AS (SELECT span, term, score, semantic AS semantic_score, fuzzy AS fuzzy_score, phonetic AS phonetic_score, len(fw) AS word_count,
  CASE WHEN list_has_any(fw, {sql_strings(G.STOPWORDS)}) THEN 1 ELSE 0 END AS contains_stopword, 0 AS contains_digit
  FROM (SELECT *, list_filter(string_split(span, ' '), lambda x: x <> '') AS fw FROM best WHERE rank = 1 AND span <> term)),
judged_forms AS (SELECT *, {_sql_probability()} AS p FROM features)"""


def sql_corrected(gated: bool, source: str = "misheard", made: str = C.MISHEARD) -> str:
    """``chosen`` (with all scores) and ``rewritten`` of the ungated or the gated correction of a table (doc_id, text).

    ``made``: the parts that make the table ``source``.
    """
    judged = _JUDGED.replace(C.MISHEARD, made, 1).replace("AS w FROM misheard)", f"AS w FROM {source})", 1)
    return f"""{judged}, hits AS (SELECT doc_id, start, "end", c.span AS original, clean, term AS candidate, f.* EXCLUDE (span, term)
  FROM candidates c JOIN judged_forms f ON c.form = f.span {f'WHERE p >= {G.THRESHOLD}' if gated else ''}),
{sql_chosen()}, {SQL_REWRITTEN},
corrected AS (SELECT r.doc_id, r.text AS corrected_text, coalesce(n, 0) AS corrections, coalesce(lost, false) AS digits_lost
  FROM rewritten r LEFT JOIN (SELECT doc_id, count(*) AS n, bool_or(regexp_matches(original, '\\p{{Nd}}') AND NOT regexp_matches(candidate, '\\p{{Nd}}')) AS lost
  FROM chosen GROUP BY doc_id) c ON r.doc_id = c.doc_id)"""


def _corrected(spark: SparkSession, sf_dir: str, gate) -> DataFrame:
    return K.correct(heard(spark, sf_dir), index(spark), "doc_id", "text", gate)


@query("correct_ungated", f"WITH {sql_corrected(False)} SELECT * FROM corrected")
def q_correct_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _corrected(spark, sf_dir, None)
    return done.select("doc_id", "corrected_text", F.size("corrections").alias("corrections"), "digits_lost")


@query("correct_gated", f"WITH {sql_corrected(True)} SELECT * FROM corrected")
def q_correct_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _corrected(spark, sf_dir, G.DEFAULT)
    return done.select("doc_id", "corrected_text", F.size("corrections").alias("corrections"), "digits_lost")


@query(
    "correction_records",
    f"""WITH {sql_corrected(True)} SELECT doc_id, '{K.GATED}' AS type, original, clean AS clean_span, candidate AS corrected,
        round(score, 4) AS retrieval_score, round(p, 4) AS gate_probability, round(semantic_score, 4) AS semantic_score,
        round(fuzzy_score, 4) AS fuzzy_score, round(phonetic_score, 4) AS phonetic_score, word_count, contains_stopword, contains_digit
        FROM chosen""",
)
def q_correction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _corrected(spark, sf_dir, G.DEFAULT)
    records = done.select("doc_id", F.inline_outer("corrections")).where(F.col("type").isNotNull())
    return records.select("*", "features.word_count", "features.contains_stopword", "features.contains_digit").drop(
        "features"
    )


@query(
    "correct_disabled",
    f"WITH {C.MISHEARD} SELECT doc_id, text AS corrected_text, 0 AS corrections FROM misheard",
)
def q_correct_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = K.correct(heard(spark, sf_dir), index(spark), "doc_id", "text", enabled=False)
    return done.select("doc_id", "corrected_text", F.size("corrections").alias("corrections"))


_WORD_PAIRS = f"""{C.MISHEARD}, ws AS (SELECT doc_id, {sql_words('text')} AS w FROM misheard),
spelled AS (SELECT DISTINCT unnest(w) AS word FROM ws),
terms AS (SELECT term, i FROM (SELECT unnest({sql_strings(K.WORD_LIST)}) AS term, unnest(range(1, {len(K.WORD_LIST) + 1})) AS i)),
near AS (SELECT word AS span, term, i FROM spelled JOIN terms ON 2 * least(length(word), length(term)) >= 0.85 * (length(word) + length(term))),
cells AS (SELECT *, regexp_extract_all(span, '(?s).') AS a, regexp_extract_all(term, '(?s).') AS b FROM near),
lcs AS (SELECT span, term, i, 2 * {LCS} / (len(a) + len(b)) AS score FROM cells),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY score DESC, i) AS place FROM lcs)
  WHERE place = 1 AND score >= 0.85 AND lower(span) <> term)"""


@query(
    "word_fuzzy_correct",
    f"""WITH {_WORD_PAIRS}, placed AS (SELECT doc_id, i, w[i] AS word FROM ws, unnest(range(1, len(w) + 1)) AS t(i)),
        edited AS (SELECT doc_id, string_agg(coalesce(term, word), ' ' ORDER BY placed.i) AS corrected_text, count(term) AS corrections
                   FROM placed LEFT JOIN best ON span = word GROUP BY doc_id)
        SELECT doc_id, coalesce(corrected_text, '') AS corrected_text, coalesce(corrections, 0) AS corrections
        FROM misheard LEFT JOIN edited USING (doc_id)""",
)
def q_word_fuzzy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = K.word_fuzzy_correct(heard(spark, sf_dir), "doc_id", "text")
    return done.select("doc_id", "corrected_text", F.size("word_corrections").alias("corrections"))


# First places of two terms, neither overlapping the other.
_MARKS = ["metformin", "chest pain"]


@query(
    "highlight_spans",
    f"""WITH {C.UTTERANCES}, u AS (SELECT doc_id, utt, reference_text AS t FROM utterances),
        found AS (SELECT *, [x for x in [struct_pack(s := instr(lower(t), '{_MARKS[0]}'), n := {len(_MARKS[0])}),
                                         struct_pack(s := instr(lower(t), '{_MARKS[1]}'), n := {len(_MARKS[1])})] if x.s > 0] AS m FROM u),
        marks AS (SELECT doc_id, utt, t, x.s AS s, x.n AS n FROM (SELECT *, unnest(m) AS x FROM found)),
        edges AS (SELECT *, lag(s + n, 1, 1) OVER (PARTITION BY doc_id, utt ORDER BY s) AS before FROM marks),
        parts AS (SELECT doc_id, utt, before AS spot, substr(t, before, s - before) AS part, false AS highlighted FROM edges WHERE s > before
          UNION ALL SELECT doc_id, utt, s, substr(t, s, n), true FROM edges
          UNION ALL SELECT doc_id, utt, coalesce(e, 1), substr(t, coalesce(e, 1)), false FROM u LEFT JOIN
            (SELECT doc_id, utt, max(s + n) AS e FROM marks GROUP BY ALL) USING (doc_id, utt) WHERE coalesce(e, 1) <= length(t))
        SELECT doc_id, utt, row_number() OVER (PARTITION BY doc_id, utt ORDER BY spot) - 1 AS pos, part, highlighted FROM parts""",
)
def q_highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*[F.lit(m) for m in _MARKS])
    parts = P.highlight_spans(F.col("reference_text"), terms)
    return (
        C.utterances(spark, sf_dir)
        .select("doc_id", "utt", F.posexplode_outer(parts).alias("pos", "p"))
        .select("doc_id", "utt", "pos", "p.part", "p.highlighted")
    )


@query("highlight_corrections")
def q_highlight_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corrected transcript with the terms its own corrections put in marked."""
    done = _corrected(spark, sf_dir, G.DEFAULT)
    terms = F.array_distinct(F.transform("corrections", lambda c: c["corrected"]))
    parts = P.highlight_spans(F.col("corrected_text"), terms)
    return done.select("doc_id", F.posexplode_outer(parts).alias("pos", "p")).select(
        "doc_id", "pos", "p.part", "p.highlighted"
    )


@query(
    "baseline_variants",
    f"""WITH {C.MISHEARD} SELECT doc_id, 'baseline_0_raw' AS baseline, text AS hypothesis FROM misheard
        UNION ALL SELECT doc_id, 'baseline_1_normalized', {sql_normalize('text')} FROM misheard""",
)
def q_baseline_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"baseline_0_raw": F.col("text"), "baseline_1_normalized": normalize(F.col("text"))}
    return S.variants(C.misheard(spark, sf_dir).select("doc_id", "text"), texts).drop("text")


def four_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, normalised, retrieval-corrected and gate-corrected text of every transcript."""
    terms = via_table(index(spark), "index")
    rows = N.baselines(heard(spark, sf_dir), terms, "doc_id", "text")
    return rows.select("doc_id", "baseline", F.col("predicted_text").alias("hypothesis"))


# Both corrections share the judged forms; only their hits differ.
_SQL_FOUR = f"""WITH raw AS (SELECT doc_id, text FROM (WITH {C.MISHEARD} SELECT doc_id, text FROM misheard)),
  ungated AS (SELECT doc_id, corrected_text FROM (WITH {sql_corrected(False)} SELECT * FROM corrected)),
  gated AS (SELECT doc_id, corrected_text FROM (WITH {sql_corrected(True)} SELECT * FROM corrected))
SELECT doc_id, '{N.BASELINES[0]}' AS baseline, text AS hypothesis FROM raw
UNION ALL SELECT doc_id, '{N.BASELINES[1]}', {sql_normalize('text')} FROM raw
UNION ALL SELECT doc_id, '{N.BASELINES[2]}', corrected_text FROM ungated
UNION ALL SELECT doc_id, '{N.BASELINES[3]}', corrected_text FROM gated"""


@query("baseline_variants_corrected", _SQL_FOUR)
def q_four_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return four_baselines(spark, sf_dir)


# The engine's own baselines, scored: samples are the misheard transcripts, their truth the transcripts before.
def vocabulary_index(spark: SparkSession) -> DataFrame:
    """The stored index of a vocabulary file."""
    path = fresh_path(spark, "terms")
    vocabulary(spark).select(F.col("term").alias("value")).write.text(path)
    files.write_index(V.build_index(files.read_vocabulary(spark, path)), path + "-index")
    return files.read_index(spark, path + "-index")


def scored_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = C.transcripts(spark, sf_dir).select("doc_id", F.col("text").alias("reference_text"))
    truth = told.select(F.col("doc_id").alias("sample_id"), F.col("reference_text").alias("reference_transcript"))
    targets = with_targets(told).select(
        F.col("doc_id").alias("target_id"), "target_keywords", "target_numerics", "target_negations")
    samples = heard(spark, sf_dir).withColumnRenamed("doc_id", "sample_id").join(
        targets, F.col("sample_id") == F.col("target_id")).drop("target_id")
    return N.evaluate_baselines(samples, truth, vocabulary_index(spark))


@query("evaluated_records")
def q_evaluated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested record of every sample, written as JSON and read back, in flat rows."""
    records = N.nested_records(scored_baselines(spark, sf_dir))
    path = fresh_path(spark, "evaluated")
    files.write_records(records, path)
    back = spark.read.schema(records.schema).json(path)
    made = {b: F.size(N.corrections_field(b)) for b in N.BASELINES[2:]}
    rows = F.array(*(F.struct(F.lit(b).alias("baseline"), F.col(b).alias("r"), made.get(b, F.lit(0)).alias("corrections")) for b in N.BASELINES))
    return back.select("sample_id", F.sha2("reference", 256).alias("reference_sha256"), F.inline(rows)).select(
        "sample_id", "reference_sha256", "baseline", "r.hypothesis", *(F.round(f"r.{m}", 6).alias(m) for m in S.SCORES), "corrections")


@query("evaluated_ablation")
def q_evaluated_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ablation(scored_baselines(spark, sf_dir))


@query("evaluated_improvement")
def q_evaluated_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.improvement(scored_baselines(spark, sf_dir), "sample_id", "baseline", N.BASELINES[0], N.BASELINES[3])


@query("evaluated_wer_series")
def q_evaluated_wer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.wer_series(scored_baselines(spark, sf_dir), "sample_id", "baseline", list(N.BASELINES))


@query("gate_from_csv")
def q_gate_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate fitted on a file of training rows and applied to all feature rows."""
    path = fresh_path(spark, "training")
    rows = feature_rows(spark, sf_dir)
    written = rows.select(
        F.concat(F.lit("span "), "vec_id").alias("span"), F.lit("term").alias("candidate"),
        *(F.col(n).cast(GATE_TRAINING[n].dataType) for n in G.FEATURE_NAMES), "should_correct")
    files.write_rows(written, path)
    model = G.fit_logistic(files.read_gate_training(spark, path))
    scored = G.predict_proba(model, rows.withColumn("features", F.struct(*G.FEATURE_NAMES)))
    return scored.select("vec_id", "should_correct", F.round("gate_probability", 6).alias("gate_probability"))
