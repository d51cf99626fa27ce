"""The pairwise metrics as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from earshot.functions.longtext import char_rate_udf, word_rate_udf
from earshot.functions.text import WORD

_WORD = WORD.replace("\\", "\\\\")


def _share(pattern: str) -> str:
    """Share of the distinct parts of ``ref`` that ``hyp`` has too; equal texts are only asked whether they have any."""
    a, b = (f"regexp_extract_all(coalesce({c}, ''), '{pattern}', 0)" for c in ("ref", "hyp"))
    some = f"CAST(regexp_like(coalesce(ref, ''), '{pattern}') AS DOUBLE)"
    share = f"size(array_intersect({a}, {b})) / greatest(1, size(array_distinct({a})))"
    return f"CASE WHEN coalesce(ref, '') = coalesce(hyp, '') THEN {some} ELSE {share} END"


FUNCTIONS = {
    "keyword_accuracy": _share(_WORD),
    "numeric_accuracy": _share(r"(?U)\\d+"),
    "negation_accuracy": "CAST(contains(coalesce(ref, ''), 'no ') = contains(coalesce(hyp, ''), 'no ') AS DOUBLE)",
}


def register(spark: SparkSession) -> None:
    """Create ``wer, cer, keyword_accuracy, numeric_accuracy, negation_accuracy`` (ref, hyp)."""
    # Called as they are: a function in SQL would give each of them its own copy of the texts.
    spark.udf.register("wer", word_rate_udf)
    spark.udf.register("cer", char_rate_udf)
    for name, body in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(ref STRING, hyp STRING) RETURNS DOUBLE RETURN {body}"
        )
