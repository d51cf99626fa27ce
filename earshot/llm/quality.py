"""Quality rules judged by host: failures per host, shrunk by an empirical beta prior, joined back.

Each document is measured in one pass over its whole text. A host (column
``source``) with few documents says little about its failure rate, so rates
are shrunk towards the rate of all hosts by a beta prior whose two parameters
come from the mean and the variance of the hosts' rates. The shrunk rate is joined back to
the documents and grades the soft rules: their limits for symbols and repeated lines are multiplied by
the prior mean over the host's shrunk rate (``leniency``, within ``LENIENCY``).
The verdict of a host says what that means:

* ``open``     no worse than the prior mean: limits as they are, or wider;
* ``strict``   worse: limits are tightened, so a document that would pass elsewhere may fail here;
* ``blocked``  from a shrunk rate of ``BLOCKED_RATE`` on, no document of the host is kept.

A document is kept if it passes the base rules, its host is not blocked, and it passes the graded soft rules.

Null or empty texts have no words and fail the base rules. Documents of a null
host have no rate; the soft rules apply to them with their own limits. Rows are judged
one by one, so ties and repeated rows get equal answers, and very long texts are counted whole, in memory
in proportion to the text; an empty table gives
an empty result. Only ``doc_id``, ``text`` and ``source`` are read, so further
columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import per_text, text_id, whole_rows
from earshot.session import salted_join, via_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Soft rules: symbols to words, repeated lines to lines, mean word length.
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTH = (2, 15)
# Shrunk failure rate from which a host is refused as a whole.
BLOCKED_RATE = 0.9
# Least and largest factor by which a host's rate moves the limits of the soft rules.
LENIENCY = (2 / 3, 3 / 2)

_SYMBOLS = b"#*$%&|<>"
_BLANK_BYTES = b" \t\n\x0b\x0c\r"
_SCHEMA = ("doc_id long, text_id long, source string, n_words long, word_chars long, n_symbols long, n_lines long, "
           "n_dup_lines long, n_repeat_words long")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows found twice or more, the first finding included."""
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + 3] = covered[j:j + 3] = b"\x01\x01\x01"
    return sum(covered)


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly the six ASCII blanks
    blanks = len(data) - len(data.translate(None, _BLANK_BYTES))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = data.split(b"\n")
    worded = [line for line in lines if line.strip(_BLANK_BYTES)]
    return (len(words), len(text) - blanks, symbols, len(lines),
            len(worded) - len(set(worded)), repeated_words(words))


def _measure(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, key, source, text in rows:
        yield doc_id, key, source, *text_stats(text)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def soft_failed(leniency: Column | None = None) -> Column:
    """Whether a soft rule fails, with the limits for symbols and repeated lines times ``leniency``."""
    low, high = WORD_LENGTH
    times = F.lit(1) if leniency is None else leniency
    return ((100 * F.col("n_symbols") > times * MAX_SYMBOL_PERCENT * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > times * MAX_DUP_LINE_PERCENT * F.col("n_lines"))
            | (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words")))


def measured(docs: DataFrame) -> DataFrame:
    """Counts and rule results of every document, written once for its two readers."""
    rows = docs.select("doc_id", text_id(), "source", "text")
    stats = per_text(rows, ["doc_id", "text_id", "source", "text"], _SCHEMA, _measure)
    return via_table(stats.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()), "quality")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta prior, by the moments of the hosts' rates.

    Equal rates, or a single host, have no variance to fit; the prior is then
    that rate with the weight of one document.
    """
    rate = F.col("failed") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        return 0.5, 0.5
    weight = mean * (1 - mean) / var - 1 if var else 1.0
    weight = max(weight, 1.0) if 0 < mean < 1 else 1.0
    return mean * weight, (1 - mean) * weight


def host_verdicts(stats: DataFrame) -> DataFrame:
    """``source, n, failed, shrunk_rate, verdict, leniency`` of each host. A hot host is summed before the shuffle."""
    hosts = via_table(
        stats.filter(F.col("source").isNotNull()).groupBy("source").agg(
            F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed")),
        "hosts")
    a, b = beta_prior(hosts)
    shrunk = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    # The mean host keeps the soft rules as they are; worse ones tighten them and better ones relax them.
    least, most = map(F.lit, LENIENCY)
    leniency = F.when(shrunk > 0, F.least(most, F.greatest(least, F.lit(a / (a + b)) / shrunk))).otherwise(F.lit(1.0))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("leniency", leniency).withColumn(
        "verdict", F.when(shrunk >= BLOCKED_RATE, "blocked").when(F.col("leniency") < 1, "strict").otherwise("open"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``host_verdict``, ``leniency`` and ``kept``."""
    stats = measured(docs)
    hosts = host_verdicts(stats).select("source", F.col("verdict").alias("host_verdict"), "leniency")
    told = salted_join(stats, hosts, "source", ["doc_id", "text_id"], "left").withColumn(
        "host_verdict", F.coalesce("host_verdict", F.lit("open"))).withColumn("leniency", F.coalesce("leniency", F.lit(1.0)))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") != "blocked") & ~soft_failed(F.col("leniency")))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, with all their columns. Rows are told apart by id, host and text."""
    kept = judge(docs).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("source").alias("kept_source"), F.col("text_id").alias("kept_text")).distinct()
    same = (F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & F.col("row.source").eqNullSafe(F.col("kept_source"))
            & (F.col("text_id") == F.col("kept_text")))
    return whole_rows(docs, text_id()).join(kept, same, "left_semi").select("row.*")
