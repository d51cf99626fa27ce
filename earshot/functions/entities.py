"""Clinical entities of a transcript: substring lexicons, patterns, intent and risk."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import let, text_or_empty

# Lexicons and patterns of the extractor.
MEDICATIONS = [
    "metformin", "lisinopril", "atorvastatin", "amlodipine", "hydroxyzine",
    "omeprazole", "torsemide", "ibuprofen", "insulin", "acetaminophen",
    "amoxicillin", "prednisone", "gabapentin", "sertraline", "losartan",
    "levothyroxine", "albuterol", "azithromycin", "hydrochlorothiazide", "pantoprazole",
]
SYMPTOMS = [
    "chest pain", "shortness of breath", "dizziness", "itching", "fever",
    "vomiting", "nausea", "cough", "headache",
]
FREQUENCIES = [
    "once daily", "twice daily", "every morning", "every night",
    "before breakfast", "before dinner", "tonight", "starting tomorrow",
]
NEGATIONS = [
    "no chest pain", "no fever", "no vomiting", "no ibuprofen",
    "not taking insulin", "denies dizziness",
]
DOSAGE = r"\b\d+\s?(?:mg|milligrams|ml|units)\b"
INTENTS = {
    "refill": "prescription_refill",
    "change": "dose_change",
    "symptom": "symptom_report",
    "medication": "medication_instruction",
    "other": "follow_up",
}
RISK_SYMPTOM = "shortness of breath"

# The larger vocabulary of medications, which ships as a file.
MEDICATION_VOCABULARY = MEDICATIONS + [
    "warfarin", "clopidogrel", "simvastatin", "rosuvastatin", "cetirizine",
    "montelukast", "furosemide", "spironolactone", "doxycycline", "naproxen",
]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lexicon_hits(lowered: Column, terms: Sequence[str], word_boundary: bool) -> Column:
    """The terms found in the text, in lexicon order."""
    if word_boundary:
        found = [F.when(lowered.rlike(rf"(?U)\b{re.escape(t)}\b"), F.lit(t)) for t in terms]
    else:
        found = [F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*found))


def _phrase_hits(lowered: Column, phrases: Sequence[str]) -> Column:
    """All whole-word matches, phrase by phrase, each in text order.

    A phrase that is not even a substring is settled without the regex.
    """
    none = F.array().cast("array<string>")
    return F.flatten(
        F.array(
            *[
                F.when(
                    F.contains(lowered, F.lit(p)),
                    F.regexp_extract_all(lowered, F.lit(rf"(?U)\b{re.escape(p)}\b"), F.lit(0)),
                ).otherwise(none)
                for p in phrases
            ]
        )
    )


def medications(text: Column, lexicon: Sequence[str] = MEDICATIONS, word_boundary: bool = False) -> Column:
    return _lexicon_hits(F.lower(text_or_empty(text)), lexicon, word_boundary)


def symptoms(text: Column, lexicon: Sequence[str] = SYMPTOMS, word_boundary: bool = False) -> Column:
    return _lexicon_hits(F.lower(text_or_empty(text)), lexicon, word_boundary)


def dosages(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("(?U)" + DOSAGE), F.lit(0))


def frequencies(text: Column, phrases: Sequence[str] = FREQUENCIES) -> Column:
    return _phrase_hits(F.lower(text_or_empty(text)), phrases)


def negations(text: Column, phrases: Sequence[str] = NEGATIONS) -> Column:
    return _phrase_hits(F.lower(text_or_empty(text)), phrases)


def intent(text: Column, symptom_hits: Column, medication_hits: Column) -> Column:
    lowered = F.lower(text_or_empty(text))
    return (
        F.when(F.contains(lowered, F.lit("refill")), INTENTS["refill"])
        .when(F.contains(lowered, F.lit("change")), INTENTS["change"])
        .when(F.size(symptom_hits) > 0, INTENTS["symptom"])
        .when(F.size(medication_hits) > 0, INTENTS["medication"])
        .otherwise(INTENTS["other"])
    )


def risk_flag(text: Column, negation_hits: Column) -> Column:
    return (F.size(negation_hits) > 0) | F.contains(F.lower(text_or_empty(text)), F.lit(RISK_SYMPTOM))


def extract_entities(
    text: Column,
    medication_lexicon: Sequence[str] = MEDICATIONS,
    symptom_lexicon: Sequence[str] = SYMPTOMS,
    word_boundary: bool = False,
) -> Column:
    """The whole extraction record of a text."""
    found = F.struct(
        F.lower(text_or_empty(text)).alias("text"),
        medications(text, medication_lexicon, word_boundary).alias("medications"),
        dosages(text).alias("dosages"),
        frequencies(text).alias("frequencies"),
        negations(text).alias("negations"),
        symptoms(text, symptom_lexicon, word_boundary).alias("symptoms"),
    )
    return let(
        found,
        lambda e: F.struct(
            e["medications"].alias("medications"),
            e["dosages"].alias("dosages"),
            e["frequencies"].alias("frequencies"),
            e["negations"].alias("negations"),
            intent(e["text"], e["symptoms"], e["medications"]).alias("intent"),
            risk_flag(e["text"], e["negations"]).alias("risk_flag"),
            e["symptoms"].alias("symptoms"),
        ),
    )
