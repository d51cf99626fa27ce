"""The registered queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from earshot.llm import (
    conversations,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    order_minhash,
    packing,
    periodic_runs,
    quality,
    simhash,
    token_counts,
    toxicity,
    training_order,
)
from earshot.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_BLANK_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(r.keep_doc <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""

_QUALITY_SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
spots AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM base WHERE len(words) >= 3),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM spots),
repeated AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM wins WHERE n >= 2) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines) AS n_lines,
         (len(list_filter(lines, lambda l: trim(l, {_BLANK_SQL}) <> ''))
          - len(list_distinct(list_filter(lines, lambda l: trim(l, {_BLANK_SQL}) <> ''))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN repeated r ON b.doc_id = r.doc_id),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words
         OR 100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines
         OR word_chars < {quality.WORD_LENGTH[0]} * n_words OR word_chars > {quality.WORD_LENGTH[1]} * n_words AS soft_failed
  FROM counted),
hosts AS (
  SELECT source, count(*) AS n, sum((base_failed OR soft_failed)::BIGINT) AS failed
  FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 AND v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS weight FROM moments),
rates AS (SELECT source, m, (failed + m * weight) / (n + weight) AS shrunk FROM hosts, prior),
verdicts AS (
  SELECT source, shrunk >= {quality.BLOCKED_RATE} AS blocked,
         CASE WHEN shrunk > 0 THEN least({quality.LENIENCY[1]!r}::DOUBLE, greatest({quality.LENIENCY[0]!r}::DOUBLE, m / shrunk)) ELSE 1.0 END AS leniency
  FROM rates),
graded AS (
  SELECT j.*, coalesce(blocked, false) AS blocked, coalesce(leniency, 1.0) AS leniency
  FROM judged j LEFT JOIN verdicts v ON j.source = v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN blocked THEN 'blocked' WHEN leniency < 1 THEN 'strict' ELSE 'open' END AS host_verdict,
       NOT base_failed AND NOT blocked
       AND NOT (100 * n_symbols > leniency * {quality.MAX_SYMBOL_PERCENT} * n_words
                OR 100 * n_dup_lines > leniency * {quality.MAX_DUP_LINE_PERCENT} * n_lines
                OR word_chars < {quality.WORD_LENGTH[0]} * n_words OR word_chars > {quality.WORD_LENGTH[1]} * n_words) AS kept
FROM graded
"""


_WORDS_SQL = """list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_DECONTAMINATION_SQL = f"""
WITH item_words AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), {decontamination.WINDOW}) AS k,
               unnest(range(1, len(w) - least(len(w), {decontamination.WINDOW}) + 2)) AS i
        FROM item_words WHERE len(w) > 0)),
grams AS (SELECT k, gram, list(item) AS items FROM item_windows GROUP BY k, gram),
lens AS (SELECT DISTINCT k FROM item_windows),
doc_words AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words JOIN lens ON len(w) >= k)),
hits AS (SELECT doc_id, i, d.k, items FROM doc_windows d JOIN grams g ON d.k = g.k AND d.gram = g.gram),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, unnest(items) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN told t ON d.doc_id = t.doc_id
"""


@_query("op1_training_order")
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(documents(spark, sf_dir))


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


@_query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


@_query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op6_line_dedup", _LINE_DEDUP_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


@_query("op7_quality_rules", _QUALITY_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_verdict", "kept")


@_query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op9_order_minhash")
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(documents(spark, sf_dir))


@_query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


# crc32 of an ASCII text, byte by byte and bit by bit.
_CRC_SQL = """xor(list_reduce(list_transform(regexp_extract_all({0}, '.'), lambda ch: unicode(ch)::BIGINT), lambda crc, b:
      list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, b)), 4294967295::BIGINT), 4294967295)"""


def _repair_sql() -> str:
    """Damage, faults and the cost program from the first turn on: a state is its cost and audit in one string, and its text."""
    blank = "[\\x20\\x09-\\x0D]"

    def add(state: str, cost: str | int, label: str, line: str | None = None, when: str = "true") -> str:
        text = f"list_append({state}.t, {line})" if line else f"{state}.t"
        key = f"lpad((left({state}.k, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({state}.k, 7) || '{label}'"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN struct_pack(k := {key}, t := {text}) END"

    def least(*states: str) -> str:
        return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"

    def inserted(source: str) -> str:
        user = [add(f"s{q}", conversations.INSERT, "I", "'user:'") for q in (0, 1, 3)]
        one = f"SELECT *, {least('s2', *user)} AS i2 FROM {source}"
        return f"SELECT *, {least('s3', add('i2', conversations.INSERT, 'I', "'assistant:'"))} AS i3 FROM ({one})"

    def kept(state: str, initial: str) -> str:
        return add(state, "more", "K", "r.role || ':' || r.text", f"NOT r.forced AND r.initial = '{initial}'")

    def reroled(state: str, role: str) -> str:
        return add(state, f"{conversations.REROLE} + more", "R", f"'{role}:' || r.text", "NOT r.forced")

    def gone(state: str) -> str:
        return add(state, conversations.DELETE, "D")

    step = [
        gone("s0"),
        least(gone("s1"), kept("s0", "s")),
        least(gone("i2"), *(f(q, x) for q in ("s0", "s1", "i3") for f, x in ((kept, "u"), (reroled, "user")))),
        least(gone("i3"), kept("i2", "a"), reroled("i2", "assistant")),
    ]
    none = "NULL::STRUCT(k VARCHAR, t VARCHAR[])"
    return f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC_SQL.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM source, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         NOT regexp_matches(text, '[.!?]{blank}*$') AS cut FROM placed),
turns AS (
  SELECT *, blank OR again AS forced, CASE WHEN cut THEN {conversations.TRUNCATED} ELSE 0 END AS more,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT forced) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
program AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, struct_pack(k := '000000', t := []::VARCHAR[]) AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM conversations
  UNION ALL
  SELECT i.conv_id, r.pos, {step[0]}, {step[1]}, {step[2]}, {step[3]}
  FROM ({inserted('program')}) i JOIN turns r ON i.conv_id = r.conv_id AND r.pos = i.pos + 1),
done AS (
  SELECT conv_id, {least('s0', 'i3')} AS best FROM ({inserted('program')}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(best.k, 6)::BIGINT AS cost,
       substr(best.k, 7) AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN counts c ON d.conv_id = c.conv_id
"""


@_query("op11_conversation_repair", _repair_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report(conversations.damage(rows), ids=rows)


# Runs as stretches of equal eight-word grams on one diagonal: a run has such a gram again a period away everywhere, and
# consecutive equal grams at one distance are one stretch. Of several periods of a stretch the smallest counts.
_RUNS_SQL = f"""
WITH base AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w0,
         {_CRC_SQL.format('doc_id::VARCHAR')} AS h FROM documents),
cut AS (SELECT *, len(w0) AS n, (h // 10) % len(w0) AS a, 3 + (h // 10) % 8 AS part FROM base),
damaged AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // part) END]) ELSE w0 END AS w FROM cut),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 8], ' ') AS gram FROM damaged, unnest(range(len(w) - 7)) AS t(i)),
pairs AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b
  ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND b.i - a.i <= a.n // {periodic_runs.REPEATS}),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest({periodic_runs.MIN_WORDS}, {periodic_runs.REPEATS} * q) GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT doc_id, i, w[i + 1] AS word FROM damaged, unnest(range(len(w))) AS t(i)),
left_over AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (d.i IS NULL) AS text, count(d.i) AS n_dropped
  FROM words x LEFT JOIN dropped d ON x.doc_id = d.doc_id AND x.i = d.i GROUP BY x.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(coalesce(text, '')) AS collapsed_sha256, m.n::BIGINT AS n_words, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM damaged m LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@_query("op12_periodic_runs", _RUNS_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(documents(spark, sf_dir))


@_query("op13_decontamination", _DECONTAMINATION_SQL)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
