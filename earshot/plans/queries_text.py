"""Registered queries: normalisation, redaction, entities, summariser records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import entities as E
from earshot.functions import pii, records
from earshot.functions.sql import register
from earshot.functions.text import DIGIT_WORDS, digit_words, normalize, normalize_doses, squeeze
from earshot.operators import reports as R
from earshot.plans import corpus as C
from earshot.plans.queries_metrics import SCORED, SQL_BLANK, pairs, sql_strings
from earshot.plans.registry import query
from earshot.session import spread

# Normalisation

DOSES = [(n, "") for n in (10, 20, 25, 40, 50, 500)] + [(n, " ") for n in (500, 5, 10, 20, 25, 40)]


# DuckDB's \b knows ASCII words only, Spark's (under the U flag) all letters. Runs of other letters are
# therefore put between underscores, which are ASCII word characters; chr(1) marks which ones to take out again.
_LETTERS = "([\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02c1\u0300-\u1fff\u2c00-\u2dff\u3040-\ud7ff]+)"


def sql_marked(expr: str) -> str:
    return rf"regexp_replace({expr}, '{_LETTERS}', concat('_', chr(1), '\1', chr(1), '_'), 'g')"


def sql_unmarked(expr: str) -> str:
    return f"replace(replace({expr}, concat('_', chr(1)), ''), concat(chr(1), '_'), '')"


def sql_doses(expr: str) -> str:
    expr = sql_marked(expr)
    for number, gap in DOSES:
        expr = rf"regexp_replace({expr}, '\b{number}{gap}mg\b', '{number} milligrams', 'gi')"
    return sql_unmarked(expr)


def sql_squeeze(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '{SQL_BLANK}', ' ', 'g'))"


def sql_normalize(expr: str) -> str:
    return sql_squeeze(sql_doses(expr))


def _sql_digits(marked: str) -> str:
    for word, digit in DIGIT_WORDS.items():
        marked = rf"regexp_replace({marked}, '\b{word}\b', '{digit}', 'gi')"
    return marked


def sql_digit_words(expr: str) -> str:
    return sql_unmarked(_sql_digits(sql_marked(expr)))


@query("normalize_doses", f"WITH {C.TRANSCRIPTS} SELECT doc_id, {sql_doses('text')} AS text FROM transcripts")
def q_normalize_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcripts(spark, sf_dir).select("doc_id", normalize_doses(F.col("text")).alias("text"))


@query("normalize", f"WITH {C.TRANSCRIPTS} SELECT doc_id, {sql_normalize('text')} AS text FROM transcripts")
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcripts(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))


@query("collapse_whitespace", f"SELECT page_id, {sql_squeeze('html')} AS text FROM pages")
def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "pages").select("page_id", squeeze(F.col("html")).alias("text"))


@query("digit_words", f"WITH {C.TRANSCRIPTS} SELECT doc_id, {sql_digit_words('text')} AS text FROM transcripts")
def q_digit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcripts(spark, sf_dir).select("doc_id", digit_words(F.col("text")).alias("text"))


# Redaction. SQL has one flag string per call, so the inline flags of the patterns are split off.


def _sql_stage(stage: str) -> tuple[str, str, str, str]:
    label, pattern, replacement = pii.STAGES[stage]
    flags = "i" if pattern.startswith("(?iU)") else ""
    # An address must not begin at a mark's underscore.
    pattern = pattern.replace(r"\b[A-Za-z0-9._%+-]+@", r"\b[A-Za-z0-9.%+-][A-Za-z0-9._%+-]*@")
    return label, pattern[pattern.index(")") + 1 :], replacement.replace("$1", r"\1"), flags


def sql_redact_steps(source: str, key: str) -> tuple[str, str]:
    """CTEs s0..s7 that follow a marked text through the stages, ``redacted`` without marks, and the name of that."""
    ctes = [f"s0 AS (SELECT {key}, {_sql_digits(sql_marked('text'))} AS text FROM {source})"]
    for i, stage in enumerate(pii.STAGES):
        label, pattern, replacement, flags = _sql_stage(stage)
        hits = f"regexp_extract_all(text, '{pattern}', 0, '{flags}')" if flags else f"regexp_extract_all(text, '{pattern}')"
        earlier = "".join(f", hits{j}" for j in range(i))
        ctes.append(
            f"s{i + 1} AS (SELECT {key}{earlier}, {hits} AS hits{i}, "
            f"regexp_replace(text, '{pattern}', '{replacement}', 'g{flags}') AS text FROM s{i})"
        )
    hits = ", ".join(f"hits{j}" for j in range(len(pii.STAGES)))
    ctes.append(f"redacted AS (SELECT {key}, {hits}, {sql_unmarked('text')} AS text FROM s{len(pii.STAGES)})")
    return ", ".join(ctes), "redacted"


REDACT_STEPS, REDACTED = sql_redact_steps("transcripts", "doc_id")


def _stage_query(number: int, stage: str) -> None:
    @query(
        f"redact_{stage}",
        f"WITH {C.TRANSCRIPTS}, {REDACT_STEPS} SELECT doc_id, len(hits{number}) AS hits, {sql_unmarked('text')} AS text FROM s{number + 1}",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = digit_words(F.col("text"))
        for earlier in list(pii.STAGES)[:number]:
            text = pii.redact_stage(text, earlier)
        docs = C.transcripts(spark, sf_dir).select("doc_id", text.alias("text"))
        _, pattern, _ = pii.STAGES[stage]
        return docs.select(
            "doc_id",
            F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hits"),
            pii.redact_stage(F.col("text"), stage).alias("text"),
        )


for _i, _stage in enumerate(pii.STAGES):
    _stage_query(_i, _stage)

_LOG = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS stage, '{pii.STAGES[stage][0]}' AS type, len(hits{i}) AS count, "
    f"array_to_string(hits{i}[1:3], '|') AS examples FROM {REDACTED} WHERE len(hits{i}) > 0"
    for i, stage in enumerate(pii.STAGES)
)


@query("redact", f"WITH {C.TRANSCRIPTS}, {REDACT_STEPS} SELECT doc_id, text AS redacted_text FROM {REDACTED}")
def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.transcripts(spark, sf_dir).select("doc_id", "text")
    return docs.select("doc_id", pii.redact_text(F.col("text")).alias("redacted_text"))


@query(
    "redaction_log",
    f"WITH {C.TRANSCRIPTS}, {REDACT_STEPS}, log AS ({_LOG}) SELECT doc_id, type, count, examples FROM log",
)
def q_redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.transcripts(spark, sf_dir).select("doc_id", "text")
    return (
        pii.redact(docs, "text")
        .select("doc_id", F.inline_outer("redactions"))
        .where(F.col("type").isNotNull())
        .select("doc_id", "type", "count", F.array_join("examples", "|").alias("examples"))
    )


@query(
    "redaction_counts",
    f"""WITH {C.TRANSCRIPTS}, {REDACT_STEPS}, log AS ({_LOG})
        SELECT type, sum(count)::BIGINT AS redactions, count(*) AS log_entries FROM log GROUP BY type""",
)
def q_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.transcripts(spark, sf_dir).select("doc_id", "text")
    return R.redaction_counts(pii.redact(docs, "text", with_examples=False))


@query(
    "redaction_spans",
    rf"""WITH {C.TRANSCRIPTS}, {REDACT_STEPS},
        cut AS (SELECT doc_id, string_split_regex(text, '\[[^\n]*?\]') AS plain,
                       regexp_extract_all(text, '\[[^\n]*?\]') AS marks FROM {REDACTED}),
        parts AS (
          SELECT doc_id, 2 * i AS place, plain[i] AS part, false AS marked FROM cut, unnest(range(1, len(plain) + 1)) AS t(i)
          UNION ALL
          SELECT doc_id, 2 * i + 1, marks[i], true FROM cut, unnest(range(1, len(marks) + 1)) AS t(i))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, part, marked
        FROM parts WHERE part <> ''""",
)
def q_redaction_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        q_redact(spark, sf_dir)
        .select("doc_id", F.posexplode_outer(pii.redaction_spans(F.col("redacted_text"))).alias("pos", "s"))
        .where(F.col("pos").isNotNull())
        .select("doc_id", "pos", "s.part", "s.marked")
    )


# Entities

_LOWER = "lower(text)"
SQL_MEDICATIONS = f"list_filter({sql_strings(E.MEDICATIONS)}, lambda t: contains({_LOWER}, t))"
SQL_SYMPTOMS = f"list_filter({sql_strings(E.SYMPTOMS)}, lambda t: contains({_LOWER}, t))"
SQL_DOSAGES = f"regexp_extract_all({_LOWER}, '{E.DOSAGE}')"


def _sql_phrases(phrases: list[str]) -> str:
    return "flatten([" + ", ".join(rf"regexp_extract_all({sql_marked(_LOWER)}, '\b{p}\b')" for p in phrases) + "])"


ENTITIES = f"""found AS (
  SELECT *, {SQL_MEDICATIONS} AS medications, {SQL_SYMPTOMS} AS symptoms, {SQL_DOSAGES} AS dosages,
         {_sql_phrases(E.FREQUENCIES)} AS frequencies, {_sql_phrases(E.NEGATIONS)} AS negations
  FROM {{source}}),
entities AS (
  SELECT *, CASE WHEN contains({_LOWER}, 'refill') THEN 'prescription_refill'
                 WHEN contains({_LOWER}, 'change') THEN 'dose_change'
                 WHEN len(symptoms) > 0 THEN 'symptom_report'
                 WHEN len(medications) > 0 THEN 'medication_instruction' ELSE 'follow_up' END AS intent,
         len(negations) > 0 OR contains({_LOWER}, 'shortness of breath') AS risk_flag FROM found)"""
TRANSCRIPT_ENTITIES = f"{C.UTTERANCES}, u AS (SELECT doc_id, utt, reference_text AS text FROM utterances), " + ENTITIES.format(
    source="u"
)
LISTS = ("medications", "symptoms", "dosages", "frequencies", "negations")


def _utterance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.utterances(spark, sf_dir).select("doc_id", "utt", F.col("reference_text").alias("text"))


def _list_query(name: str, fn) -> None:
    @query(
        name,
        f"WITH {TRANSCRIPT_ENTITIES} SELECT doc_id, utt, array_to_string({name}, '|') AS {name} FROM entities",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.array_join(fn(F.col("text")), "|")
        return _utterance_texts(spark, sf_dir).select("doc_id", "utt", found.alias(name))


for _name, _fn in zip(LISTS, (E.medications, E.symptoms, E.dosages, E.frequencies, E.negations)):
    _list_query(_name, _fn)


def _utterance_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utterance_texts(spark, sf_dir).select("doc_id", "utt", E.extract_entities(F.col("text")).alias("e"))


@query("intent", f"WITH {TRANSCRIPT_ENTITIES} SELECT doc_id, utt, intent FROM entities")
def q_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _utterance_texts(spark, sf_dir).select(
        "doc_id", "utt", E.intent(text, E.symptoms(text), E.medications(text)).alias("intent")
    )


@query("risk_flag", f"WITH {TRANSCRIPT_ENTITIES} SELECT doc_id, utt, risk_flag FROM entities")
def q_risk_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _utterance_texts(spark, sf_dir).select(
        "doc_id", "utt", E.risk_flag(text, E.negations(text)).alias("risk_flag")
    )


_JOINED = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in LISTS)


def flat_entities(df: DataFrame, record: str = "e") -> DataFrame:
    """The extraction record as plain columns, lists joined by a bar."""
    lists = [F.array_join(f"{record}.{c}", "|").alias(c) for c in LISTS]
    return df.select(
        *[c for c in df.columns if c != record], *lists, F.col(f"{record}.intent"), F.col(f"{record}.risk_flag")
    )


@query(
    "extract_entities",
    f"WITH {TRANSCRIPT_ENTITIES} SELECT doc_id, utt, {_JOINED}, intent, risk_flag FROM entities",
)
def q_extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_entities(_utterance_entities(spark, sf_dir))


@query(
    "intent_counts",
    f"WITH {TRANSCRIPT_ENTITIES} SELECT intent, risk_flag, count(*) AS utterances FROM entities GROUP BY ALL",
)
def q_intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _utterance_entities(spark, sf_dir).select("e.intent", "e.risk_flag")
    return rows.groupBy("intent", "risk_flag").agg(F.count(F.lit(1)).alias("utterances"))


# Summariser records. The answers are built from the events, one shape per event.

_OBJECT = (
    """concat('{"summary": "event ', event_type, '", "medications": ["a', user_id, '", "b"], "symptoms": "x, ', """
    """event_type, ' , ", "dosages": null, "next_steps": ["call"], "follow_up": " visit ', user_id, ' ", "risk_flag": ', """
    """CASE WHEN event_id % 5 = 0 THEN 'true' WHEN event_id % 5 = 1 THEN 'false' WHEN event_id % 5 = 2 THEN '"high"' """
    """WHEN event_id % 5 = 3 THEN 'null' ELSE '""' END, '}')"""
)
_ANSWER = f"""CASE event_id % 7
  WHEN 0 THEN {_OBJECT}
  WHEN 1 THEN concat('```json', chr(10), {_OBJECT}, chr(10), '```')
  WHEN 2 THEN concat('  ```', chr(10), {_OBJECT}, '  ')
  WHEN 3 THEN concat('Sorry, ', event_type, ' {{"summary":')
  WHEN 4 THEN concat('{{"medications": ', user_id, ', "risk": "yes", "symptoms": "none"}}')
  WHEN 5 THEN concat('[1, ', user_id, ']')
  ELSE props END"""
_AUDIENCE = "CASE WHEN event_id % 2 = 0 THEN 'patient' ELSE 'clinician' END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events").select(
        "event_id", F.expr(_ANSWER).alias("answer"), F.expr(_AUDIENCE).alias("audience")
    )


def _sql_strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{SQL_BLANK}|{SQL_BLANK}$', '', 'g')"


ANSWERS = rf"""answers AS (SELECT event_id, {_ANSWER} AS answer, {_AUDIENCE} AS audience FROM events),
stripped AS (SELECT *, {_sql_strip('answer')} AS t, string_split_regex({_sql_strip('answer')}, '\r\n|[\n\r]') AS lines FROM answers),
inner_text AS (SELECT *, CASE WHEN starts_with(t, '```') THEN {_sql_strip(
    "array_to_string(CASE WHEN len(lines) > 1 AND starts_with(lines[-1], '```') THEN lines[2:len(lines)-1] ELSE lines[2:] END, chr(10))"
)} END AS inside FROM stripped),
cleaned AS (SELECT event_id, audience, answer,
    CASE WHEN inside IS NULL THEN t WHEN lower(inside[1:4]) = 'json' THEN {_sql_strip('inside[5:]')} ELSE inside END AS text
  FROM inner_text)"""


@query("strip_code_fences", f"WITH {ANSWERS} SELECT event_id, text FROM cleaned")
def q_strip_code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("event_id", records.strip_code_fences(F.col("answer")).alias("text"))


def _sql_list(name: str) -> str:
    path = f"json_extract(j, '$.{name}')"
    text = f"json_extract_string(j, '$.{name}')"
    return f"""CASE coalesce(json_type({path}), 'NULL') WHEN 'NULL' THEN []::VARCHAR[]
        WHEN 'ARRAY' THEN CAST({path} AS VARCHAR[])
        WHEN 'VARCHAR' THEN list_filter(list_transform(string_split({text}, ','), lambda p: trim(p)), lambda p: p <> '')
        ELSE [{text}] END"""


PARSED = f"""{ANSWERS}, typed AS (
  SELECT *, CASE WHEN json_valid(text) THEN CASE WHEN json_type(text::JSON) = 'OBJECT' THEN text::JSON END END AS j FROM cleaned),
parsed AS (
  SELECT event_id, audience, answer, j, j IS NULL AS parse_error,
    coalesce(json_extract_string(j, '$.summary'), '') AS summary,
    {_sql_list('medications')} AS medications, {_sql_list('symptoms')} AS symptoms, {_sql_list('dosages')} AS dosages,
    CASE WHEN audience = 'patient' THEN {_sql_list('next_steps')} END AS next_steps,
    CASE WHEN audience <> 'patient' THEN {_sql_list('follow_up')} END AS follow_up,
    CASE coalesce(json_type(json_extract(j, '$.risk_flag')), 'NULL') WHEN 'NULL' THEN false
      WHEN 'BOOLEAN' THEN json_extract_string(j, '$.risk_flag') = 'true'
      ELSE json_extract_string(j, '$.risk_flag') <> '' END AS risk_flag
  FROM typed)"""


@query(
    "ensure_list",
    f"WITH {PARSED} SELECT event_id, array_to_string(medications, '|') AS medications, "
    "array_to_string(symptoms, '|') AS symptoms, array_to_string(dosages, '|') AS dosages FROM parsed",
)
def q_ensure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.try_parse_json(records.strip_code_fences(F.col("answer")))
    parsed = answers(spark, sf_dir).select("event_id", payload.alias("j"))
    return parsed.select(
        "event_id",
        *[
            F.array_join(records.ensure_list(F.try_variant_get("j", f"$.{name}", "variant")), "|").alias(name)
            for name in records.LIST_FIELDS
        ],
    )


_FLAT = (
    "summary, array_to_string(medications, '|') AS medications, array_to_string(symptoms, '|') AS symptoms, "
    "array_to_string(dosages, '|') AS dosages, array_to_string(next_steps, '|') AS next_steps, "
    "array_to_string(follow_up, '|') AS follow_up, risk_flag"
)


def _flat_record(df: DataFrame, *keys: str) -> DataFrame:
    lists = [F.array_join(f"r.{c}", "|").alias(c) for c in (*records.LIST_FIELDS, "next_steps", "follow_up")]
    return df.select("event_id", "r.summary", *lists, "r.risk_flag", *keys)


@query("normalize_payload", f"WITH {PARSED} SELECT event_id, {_FLAT} FROM parsed WHERE NOT parse_error")
def q_normalize_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = answers(spark, sf_dir).select(
        "event_id", "audience", F.try_parse_json(records.strip_code_fences(F.col("answer"))).alias("j")
    )
    objects = parsed.where(F.startswith(F.schema_of_variant("j"), F.lit("OBJECT")))
    return _flat_record(
        objects.select("event_id", records.normalize_payload(F.col("j"), F.col("audience")).alias("r"))
    )


@query(
    "safe_parse",
    f"WITH {PARSED} SELECT event_id, {_FLAT}, parse_error, CASE WHEN parse_error THEN answer END AS raw_output FROM parsed",
)
def q_safe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = records.safe_parse(F.col("answer"), F.col("audience"))
    return _flat_record(
        answers(spark, sf_dir).select("event_id", record.alias("r")), "r.parse_error", "r.raw_output"
    )


_RISK = "coalesce(nullif(json_extract(j, '$.risk_flag'), 'null'::JSON), nullif(json_extract(j, '$.risk'), 'null'::JSON))"


@query(
    "risk_level",
    f"""WITH {PARSED} SELECT event_id, CASE WHEN {_RISK} IS NULL THEN 'unknown'
        WHEN {_RISK}::VARCHAR IN ('true', '"true"', '"high"', '"yes"') THEN 'risky' ELSE 'clear' END AS risk FROM parsed""",
)
def q_risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.try_parse_json(records.strip_code_fences(F.col("answer")))
    return answers(spark, sf_dir).select("event_id", payload.alias("j")).select(
        "event_id", records.risk_level(F.col("j")).alias("risk")
    )


_PROMPT = {k: v.replace("'", "''") for k, v in records.PROMPTS.items()}


@query(
    "summary_prompt",
    f"""WITH {C.TRANSCRIPTS}, {REDACT_STEPS} SELECT doc_id, {_sql_strip(
        f"concat(CASE WHEN doc_id % 2 = 0 THEN '{_PROMPT['patient']}' ELSE '{_PROMPT['clinician']}' END, text)"
    )} AS prompt FROM {REDACTED}""",
)
def q_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    audience = F.when(F.col("doc_id") % 2 == 0, "patient").otherwise("clinician")
    return q_redact(spark, sf_dir).select(
        "doc_id", records.summary_prompt(F.col("redacted_text"), audience).alias("prompt")
    )


@query(
    "sql_functions",
    f"""WITH {SCORED} SELECT baseline_name, condition, round(avg("WER"), 6) AS wer, round(avg("CER"), 6) AS cer,
        round(avg("KeywordAcc"), 6) AS keyword_accuracy, round(avg("NumericAcc"), 6) AS numeric_accuracy,
        round(avg("NegationAcc"), 6) AS negation_accuracy FROM scored GROUP BY ALL""",
)
def q_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    pairs(spark, sf_dir).createOrReplaceTempView("earshot_predictions")
    return spark.sql(
        """SELECT baseline_name, condition, round(avg(wer(reference_text, predicted_text)), 6) AS wer,
                  round(avg(cer(reference_text, predicted_text)), 6) AS cer,
                  round(avg(keyword_accuracy(reference_text, predicted_text)), 6) AS keyword_accuracy,
                  round(avg(numeric_accuracy(reference_text, predicted_text)), 6) AS numeric_accuracy,
                  round(avg(negation_accuracy(reference_text, predicted_text)), 6) AS negation_accuracy
           FROM earshot_predictions GROUP BY baseline_name, condition"""
    )


@query(
    "sql_function_cer",
    rf"""WITH {C.CHUNKS}, heard AS (
          SELECT *, {C.sql_replace_all('text', C.RAW_ERRORS)} AS h FROM chunks),
        chars AS (SELECT *, regexp_extract_all(text, '(?s).') AS rc, regexp_extract_all(h, '(?s).') AS hc FROM heard),
        symbols AS (SELECT *, list_distinct(list_concat(rc, hc)) AS cv FROM chars)
        SELECT session_id, chunk_index,
          levenshtein(array_to_string(list_transform(rc, lambda t: chr(list_position(cv, t)::INT)), ''),
                      array_to_string(list_transform(hc, lambda t: chr(list_position(cv, t)::INT)), ''))
          / greatest(1, length(text)) AS cer FROM symbols""",
)
def q_sql_function_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    heard = spread(C.chunks(spark, sf_dir), "session_id", "chunk_index").withColumn("heard", C.replace_all(F.col("text"), C.RAW_ERRORS))
    heard.createOrReplaceTempView("earshot_chunks")
    return spark.sql("SELECT session_id, chunk_index, cer(text, heard) AS cer FROM earshot_chunks")
