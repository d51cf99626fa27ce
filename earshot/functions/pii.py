"""Redaction of personal data. The stages run in a fixed order, each on the last one's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import digit_words, let, text_or_empty

# What each stage looks for.
PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
DOB = r"\b(?:DOB[:\s]*)?(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)?\d{2}\b"
MRN = r"\b(?:MRN|Medical Record Number)[:\s#-]*[A-Za-z0-9-]+\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
# A digit run after the words counts from four digits on, which the pattern itself demands.
SSN_CONTEXT = (
    r"((?:social security number|ssn)\s*(?:is|:)?\s*)"
    r"(?:[\s,.\-]*\d){4}[\d\s,.\-]*"
)
SPOKEN_SSN = r"\b(?:\d[\s,.\-]*){9}\b"

# stage -> (label, pattern with Unicode classes as the flags say, replacement)
STAGES = {
    "phone": ("PHONE", "(?U)" + PHONE, "[REDACTED_PHONE]"),
    "email": ("EMAIL", "(?U)" + EMAIL, "[REDACTED_EMAIL]"),
    "dob": ("DOB", "(?iU)" + DOB, "[REDACTED_DOB]"),
    "mrn": ("MRN", "(?iU)" + MRN, "[REDACTED_MRN]"),
    "ssn": ("SSN", "(?U)" + SSN, "[REDACTED_SSN]"),
    "ssn_context": ("SSN", "(?iU)" + SSN_CONTEXT, "$1[REDACTED_SSN]"),
    "spoken_ssn": ("SSN", "(?U)" + SPOKEN_SSN, "[REDACTED_SSN]"),
}


def redact_stage(c: Column, stage: str) -> Column:
    """One stage alone."""
    _, pattern, replacement = STAGES[stage]
    return F.regexp_replace(c, pattern, replacement)


def redact_text(c: Column) -> Column:
    """All stages; the redacted text only."""
    out = digit_words(c)
    for stage in STAGES:
        out = redact_stage(out, stage)
    return out


_LOG = "array<struct<type:string,count:int,examples:array<string>>>"


def redact_record(c: Column, with_examples: bool = True) -> Column:
    """``redacted_text`` and the log ``redactions`` (type, count, first three examples).

    The text and its log are threaded through the stages as one bound value,
    so the log reads the very text its stage saw and no stage runs twice.
    Without examples the log carries counts only and no personal data.
    """

    def run(stage: str):
        label, pattern, _ = STAGES[stage]

        def found(s: Column) -> Column:
            hits = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
            return F.struct(s["text"].alias("text"), s["log"].alias("log"), hits.alias("hits"))

        def applied(s: Column) -> Column:
            hit = F.size(s["hits"]) > 0
            entry = F.struct(
                F.lit(label).alias("type"),
                F.size(s["hits"]).alias("count"),
                (F.slice(s["hits"], 1, 3) if with_examples else F.array().cast("array<string>")).alias("examples"),
            )
            return F.struct(
                F.when(hit, redact_stage(s["text"], stage)).otherwise(s["text"]).alias("text"),
                F.when(hit, F.concat(s["log"], F.array(entry))).otherwise(s["log"]).alias("log"),
            )

        return lambda state: let(let(state, found), applied)

    state = F.struct(digit_words(c).alias("text"), F.array().cast(_LOG).alias("log"))
    for stage in STAGES:
        state = run(stage)(state)
    return let(state, lambda s: F.struct(s["text"].alias("redacted_text"), s["log"].alias("redactions")))


def redact(df: DataFrame, text: str, with_examples: bool = True) -> DataFrame:
    """Add ``redacted_text`` and ``redactions`` to every row."""
    record = redact_record(F.col(text), with_examples)
    return df.withColumn("_redaction", record).select(*df.columns, "_redaction.*")


def redaction_spans(c: Column) -> Column:
    """A redacted text as parts in order, marked ones being the [...] labels.

    Empty plain parts between two labels are left out.
    """
    text = text_or_empty(c)
    plain = F.split(text, r"\[[^\n]*?\]")
    marks = F.regexp_extract_all(text, F.lit(r"\[[^\n]*?\]"), F.lit(0))
    empty = F.array().cast("array<struct<part:string,marked:boolean>>")

    def part(value: Column, marked: bool) -> Column:
        return F.struct(value.alias("part"), F.lit(marked).alias("marked"))

    pairs = F.flatten(
        F.transform(
            F.arrays_zip(plain.alias("plain"), marks.alias("mark")),
            lambda z: F.concat(
                empty,
                F.array(part(z["plain"], False)),
                F.when(z["mark"].isNotNull(), F.array(part(z["mark"], True))).otherwise(empty),
            ),
        )
    )
    return F.filter(pairs, lambda p: p["part"] != "")
