"""Text prepared for, and structured records returned by, a summariser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import BLANK, let, text_or_empty

LIST_FIELDS = ("medications", "symptoms", "dosages")
FOLLOW_FIELD = {"patient": "next_steps", "clinician": "follow_up"}

_RULES = (
    "Use only what the transcript says and mark what is unclear. "
    "Answer with one bare JSON object and nothing around it. "
    "Its keys are summary (text), medications, symptoms, dosages, {follow} (lists of texts, empty when "
    "nothing was said) and risk_flag (true or false)."
)
PROMPTS = {
    "patient": "Explain this redacted call to the patient in a few plain everyday sentences. "
    + _RULES.format(follow="next_steps")
    + "\n\nTranscript:\n",
    "clinician": "Document this redacted call for a clinician: medications, symptoms, doses, frequencies, follow-up. "
    + _RULES.format(follow="follow_up")
    + "\n\nTranscript:\n",
}

_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def summary_prompt(redacted: Column, audience: Column) -> Column:
    """The request for one redacted transcript; any audience but a patient gets the clinical one."""
    opening = F.when(audience == "patient", PROMPTS["patient"]).otherwise(PROMPTS["clinician"])
    return strip(F.concat(opening, text_or_empty(redacted)))


def strip_code_fences(c: Column) -> Column:
    """The text without a surrounding code fence and its leading language tag."""

    def unfenced(t: Column) -> Column:
        lines = F.split(t, _LINE_END)
        rest = F.slice(lines, F.lit(2), F.size(lines))
        closed = F.size(rest) > 0
        last = F.when(closed, F.element_at(rest, -1)).otherwise("")
        body = F.when(F.startswith(last, F.lit("```")), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
        return let(strip(F.array_join(body, "\n")), lambda b: strip(F.regexp_replace(b, "(?i)^json", "")))

    return let(strip(text_or_empty(c)), lambda t: F.when(F.startswith(t, F.lit("```")), unfenced(t)).otherwise(t))


def _texts(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def ensure_list(value: Column) -> Column:
    """A list of texts from a JSON value: null, list, text with or without commas, anything else."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = value.cast("string")
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    return (
        F.when(kind == "VOID", _texts())
        .when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<string>"))
        .when(kind == "STRING", parts)
        .when(kind == "BOOLEAN", _texts(F.initcap(text)))
        .otherwise(_texts(text))
    )


def _truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: non-zero, non-empty; the text "false" does."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = value.cast("string")
    return (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(F.startswith(kind, F.lit("ARRAY")), ~text.isin("[]"))
        .when(F.startswith(kind, F.lit("OBJECT")), ~text.isin("{}"))
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
    )


def _field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "variant")


def normalize_payload(payload: Column, audience: Column) -> Column:
    """A parsed JSON object with every field present and of its type."""
    patient = audience == "patient"
    lists = [ensure_list(_field(payload, name)).alias(name) for name in LIST_FIELDS]
    return F.struct(
        F.coalesce(_field(payload, "summary").cast("string"), F.lit("")).alias("summary"),
        *lists,
        F.when(patient, ensure_list(_field(payload, "next_steps"))).alias("next_steps"),
        F.when(~patient, ensure_list(_field(payload, "follow_up"))).alias("follow_up"),
        _truthy(_field(payload, "risk_flag")).alias("risk_flag"),
        F.lit(None).cast("string").alias("raw_output"),
        F.lit(False).alias("parse_error"),
    )


def _error_record(raw: Column, audience: Column) -> Column:
    patient = audience == "patient"
    return F.struct(
        F.lit("").alias("summary"),
        *[_texts().alias(name) for name in LIST_FIELDS],
        F.when(patient, _texts()).alias("next_steps"),
        F.when(~patient, _texts()).alias("follow_up"),
        F.lit(False).alias("risk_flag"),
        raw.alias("raw_output"),
        F.lit(True).alias("parse_error"),
    )


def safe_parse(raw: Column, audience: Column) -> Column:
    """The record in a summariser's answer, or an empty record that keeps the answer."""

    def record(payload: Column) -> Column:
        is_object = F.startswith(F.coalesce(F.schema_of_variant(payload), F.lit("VOID")), F.lit("OBJECT"))
        return F.when(is_object, normalize_payload(payload, audience)).otherwise(_error_record(raw, audience))

    return let(strip_code_fences(raw), lambda text: let(F.coalesce(F.try_parse_json(text), _last_values(text)), record))


_FIELDS = ("summary", *LIST_FIELDS, "next_steps", "follow_up", "risk_flag")


def _last_values(text: Column) -> Column:
    """The known fields of an object whose keys are repeated, the last value of each; null if it is no JSON.

    The variant parser refuses repeated keys; the reader of named fields does not.
    """
    schema = ", ".join(f"{name} variant" for name in _FIELDS) + ", _broken string"
    read = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_broken"})
    return let(read, lambda r: F.when(r["_broken"].isNull() & text.startswith("{") & text.endswith("}"), F.to_variant_object(
        F.struct(*(r[name].alias(name) for name in _FIELDS)))))


def risk_level(payload: Column) -> Column:
    """"risky", "clear" or "unknown" from ``risk_flag`` or its alias ``risk``."""

    def level(value: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        text = value.cast("string")
        risky = ((kind == "BOOLEAN") & (text == "true")) | ((kind == "STRING") & text.isin("true", "high", "yes"))
        return F.when(kind == "VOID", "unknown").when(risky, "risky").otherwise("clear")

    flag, alias = _field(payload, "risk_flag"), _field(payload, "risk")
    flag_absent = F.coalesce(F.schema_of_variant(flag), F.lit("VOID")) == "VOID"
    return F.when(flag_absent, level(alias)).otherwise(level(flag))
