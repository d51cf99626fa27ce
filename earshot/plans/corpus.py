"""Clinical evaluation inputs derived from the given tables.

The tables hold invented prose. Frequent words of it are replaced by clinical
phrases, and a hypothesis is a reference with typical recognition errors put
in, so every row and the whole of every text is used. Each derivation is
given twice, as DataFrame and as the SQL the checks run on the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import spread

# Common words of the prose and the clinical phrase that takes their place.
CLINICAL = [
    (" that ", " metformin 500mg twice daily "),
    (" with ", " no fever "),
    (" from ", " hydroxyzine 25 mg every night "),
    (" was ", " chest pain "),
    (" are ", " lisinopril 10 milligrams once daily "),
    (" by ", " denies dizziness "),
    (" que ", " atorvastatin 40mg "),
    (" der ", " keep taking insulin 10 units "),
    (" und ", " amlodipine 5 mg before breakfast "),
    (" les ", " please refill omeprazole "),
    (" las ", " change the dose of torsemide "),
    (" this ", " shortness of breath "),
    (" von ", " call 555 010 4477 "),
    (" para ", " DOB: 01/02/1990 MRN: A-7731 "),
    (" ein ", " ssn is one two three four five "),
    (" avec ", " SSN 123-45-6789 "),
]

# Recognition errors of the raw system and of the corrected one.
RAW_ERRORS = [
    ("metformin", "met forman"),
    ("hydroxyzine", "hydroxylzene"),
    ("lisinopril", "less in april"),
    ("atorvastatin", "atorvastaten"),
    ("omeprazole", "omeprazol"),
    ("torsemide", "torsemid"),
    ("500mg", "50 mg"),
    ("no fever", "fever"),
    ("the ", ""),
    ("tion", "shun"),
    ("and", "an d"),
]
GATED_ERRORS = [
    ("lisinopril", "less in april"),
    ("tion", "shun"),
    ("the ", ""),
]


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def sql_replace_all(expr: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def condition_of(key: Column) -> Column:
    place = F.pmod(key, F.lit(3))
    return F.when(place == 0, "clean").when(place == 1, "noisy").otherwise("telephony")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clinical transcript per document, dealt to all cores."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return documents.withColumn("text", replace_all(F.col("text"), CLINICAL))


TRANSCRIPTS = f"""transcripts AS (
  SELECT doc_id, lang, source, {sql_replace_all("text", CLINICAL)} AS text FROM documents)"""


def misheard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transcripts as the raw system hears them."""
    return transcripts(spark, sf_dir).withColumn("text", replace_all(F.col("text"), RAW_ERRORS))


MISHEARD = f"""{TRANSCRIPTS}, misheard AS (
  SELECT doc_id, lang, source, {sql_replace_all("text", RAW_ERRORS)} AS text FROM transcripts)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts cut at full stops and line ends, every part kept.

    The outer form of the generator spares the filter on the array's size
    that Catalyst would add below it, and with it a second cut of each text.
    """
    return (
        transcripts(spark, sf_dir)
        .select("doc_id", "lang", "source", F.posexplode_outer(F.split("text", r"[.\n]+")).alias("utt", "reference_text"))
        .where(F.col("reference_text").rlike(r"\S"))
    )


UTTERANCES = rf"""{TRANSCRIPTS}, utterances AS (
  SELECT * FROM (
    SELECT doc_id, lang, source, unnest(parts) AS reference_text, generate_subscripts(parts, 1) - 1 AS utt
    FROM (SELECT *, string_split_regex(text, '[.\n]+') AS parts FROM transcripts))
  WHERE regexp_matches(reference_text, '\S'))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of two systems over all utterances."""
    raw = replace_all(F.col("reference_text"), RAW_ERRORS)
    gated = replace_all(F.col("reference_text"), GATED_ERRORS)
    systems = F.array(
        F.struct(F.lit("raw_asr").alias("baseline_name"), raw.alias("predicted_text")),
        F.struct(F.lit("gated_retrieval").alias("baseline_name"), gated.alias("predicted_text")),
    )
    return utterances(spark, sf_dir).select(
        F.concat_ws("-", "doc_id", "utt").alias("sample_id"),
        condition_of(F.col("doc_id")).alias("condition"),
        "lang",
        "source",
        "reference_text",
        F.inline(systems),
    )


PREDICTIONS = rf"""{UTTERANCES}, predictions AS (
  SELECT concat(doc_id, '-', utt) AS sample_id,
         CASE doc_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'noisy' ELSE 'telephony' END AS condition,
         lang, source, reference_text, baseline_name, predicted_text
  FROM (
    SELECT *, 'raw_asr' AS baseline_name, {sql_replace_all("reference_text", RAW_ERRORS)} AS predicted_text
    FROM utterances
    UNION ALL
    SELECT *, 'gated_retrieval', {sql_replace_all("reference_text", GATED_ERRORS)} FROM utterances))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session chunks: one conversation is a session, one turn a chunk."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("chunk_index"),
        replace_all(F.col("text"), CLINICAL).alias("text"),
    )


CHUNKS = f"""chunks AS (
  SELECT conv_id AS session_id, turn AS chunk_index, {sql_replace_all("text", CLINICAL)} AS text
  FROM conversations)"""
