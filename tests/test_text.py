import pytest
from pyspark.sql import functions as F

from earshot.functions import entities as E
from earshot.functions import pii, records
from earshot.functions.text import digit_words, normalize


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("take 10MG and 5 mg", "take 10 milligrams and 5 milligrams"),
        ("5mg and 50 mg stay", "5mg and 50 mg stay"),
        ("  much \n  space\t", "much space"),
        ("110mg", "110mg"),
        (None, ""),
    ],
)
def test_normalize(spark, text, want):
    assert one(spark, text, normalize) == want


def test_digit_words(spark):
    assert one(spark, "One stone, NINE nines", digit_words) == "1 stone, 9 nines"
    assert one(spark, "éone one", digit_words) == "éone 1"


REDACTIONS = [
    ("ssn is 1234 and x", "ssn is [REDACTED_SSN]and x"),
    ("my SSN 12 then", "my SSN 12 then"),
    ("MRN is 12345", "[REDACTED_MRN] 12345"),
    ("MRN: 5551234567", "MRN: [REDACTED_PHONE]"),
    ("one two three four five six seven eight nine", "[REDACTED_SSN]"),
    ("1 2 3 4 5 6 7 8 9 0", "[REDACTED_SSN]0"),
    ("10, 20, 300, 40", "[REDACTED_SSN]"),
    (
        "DOB: 01/02/1990 call (743) 555-3824 or +1 743 555 3824",
        "[REDACTED_DOB] call ([REDACTED_PHONE] or +[REDACTED_PHONE]",
    ),
    ("5-10-20", "[REDACTED_DOB]"),
    ("123456789 1234567890", "[REDACTED_SSN] [REDACTED_PHONE]"),
    ("mail jo.p@ex-a.org now", "mail [REDACTED_EMAIL] now"),
    (None, ""),
]


@pytest.mark.parametrize("text, want", REDACTIONS)
def test_redaction(spark, text, want):
    assert one(spark, text, pii.redact_text) == want
    assert one(spark, text, pii.redact_record)["redacted_text"] == want


def test_redaction_log(spark):
    text = "555 010 4477, 555 010 4478, 555 010 4479, 555 010 4480; ssn 1234, then 123-45-6789"
    log = one(spark, text, pii.redact_record)["redactions"]
    assert [(e["type"], e["count"], len(e["examples"])) for e in log] == [("PHONE", 4, 3), ("SSN", 1, 1), ("SSN", 1, 1)]
    quiet = one(spark, text, lambda c: pii.redact_record(c, with_examples=False))["redactions"]
    assert all(e["examples"] == [] for e in quiet) and [e["count"] for e in quiet] == [4, 1, 1]


def test_redaction_spans(spark):
    parts = one(spark, "a [X] b[Y][Z]", pii.redaction_spans)
    assert [(p["part"], p["marked"]) for p in parts] == [("a ", False), ("[X]", True), (" b", False), ("[Y]", True), ("[Z]", True)]


def test_entities(spark):
    text = "Refill Metformin 500 mg twice daily, no fever; tonight 5units and tonight"
    got = one(spark, text, E.extract_entities)
    assert got["medications"] == ["metformin"] and got["dosages"] == ["500 mg", "5units"]
    assert got["frequencies"] == ["twice daily", "tonight", "tonight"]
    assert got["negations"] == ["no fever"] and got["symptoms"] == ["fever"]
    assert got["intent"] == "prescription_refill" and got["risk_flag"] is True


@pytest.mark.parametrize(
    "text, intent",
    [("exchange", "dose_change"), ("a cough", "symptom_report"), ("insulin", "medication_instruction"), ("", "follow_up"), (None, "follow_up")],
)
def test_intents(spark, text, intent):
    assert one(spark, text, E.extract_entities)["intent"] == intent


def test_word_boundary_option(spark):
    assert one(spark, "feverish", E.symptoms) == ["fever"]
    assert one(spark, "feverish", lambda c: E.symptoms(c, word_boundary=True)) == []


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('```\nJSON {"a": 1}', '{"a": 1}'),
        ("```", ""),
        ("  plain ", "plain"),
        (None, ""),
    ],
)
def test_fences(spark, text, want):
    assert one(spark, text, records.strip_code_fences) == want


def parsed(spark, text, audience="patient"):
    return one(spark, text, lambda c: records.safe_parse(c, F.lit(audience)))


def test_safe_parse(spark):
    got = parsed(spark, '```json\n{"summary": "s", "medications": "a, b ,", "symptoms": null, "dosages": ["1"], "next_steps": 5, "risk_flag": "false"}\n```')
    assert got["summary"] == "s" and got["medications"] == ["a", "b"] and got["symptoms"] == []
    assert got["dosages"] == ["1"] and got["next_steps"] == ["5"] and got["follow_up"] is None
    assert got["risk_flag"] is True and got["parse_error"] is False
    clinical = parsed(spark, '{"follow_up": [" x "], "medications": " "}', "clinician")
    assert clinical["follow_up"] == [" x "] and clinical["medications"] == [] and clinical["next_steps"] is None


@pytest.mark.parametrize("text", ["oops {", "[1, 2]", "", '"text"'])
def test_parse_errors(spark, text):
    got = parsed(spark, text)
    assert got["parse_error"] is True and got["raw_output"] == text and got["next_steps"] == [] and got["risk_flag"] is False


@pytest.mark.parametrize(
    "text, level",
    [('{"risk_flag": true}', "risky"), ('{"risk_flag": "High"}', "clear"), ('{"risk": "yes"}', "risky"),
     ('{"risk_flag": null, "risk": false}', "clear"), ("{}", "unknown")],
)
def test_risk(spark, text, level):
    assert one(spark, text, lambda c: records.risk_level(F.try_parse_json(c))) == level


def test_repeated_keys_keep_the_last_value(spark):
    from earshot.functions.records import safe_parse

    rows = ['{"summary": "a", "summary": "b", "symptoms": "p, q"}', '{"summary": "a", "summary": ', '{"a": {"b": 1, "b": 2}} x']
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(safe_parse(F.col("t"), F.lit("patient")).alias("r"))
    got = [r["r"] for r in df.collect()]
    assert got[0]["summary"] == "b" and got[0]["symptoms"] == ["p", "q"] and not got[0]["parse_error"]
    assert got[1]["parse_error"] and got[2]["parse_error"]
