import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot import schemas
from earshot.functions import signal as W
from earshot.operators import augment as A
from earshot.operators import evaluation, reports, scoring
from earshot.operators import retrieval as V
from earshot.operators import sessions as T
from earshot.operators import truth as J
from earshot.session import salted_join, shared_dir
from earshot.sources import files
from earshot.streaming import live


def test_read_csv_and_json(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        'sample_id,condition,reference_text,predicted_text,baseline_name\ns1,clean,"a, ""b""",,x\n'
    )
    row = files.read_predictions(spark, str(tmp_path / "p.csv")).first()
    assert row["reference_text"] == 'a, "b"' and row["predicted_text"] is None
    (tmp_path / "p.json").write_text(
        '{"sample_id": "s1", "condition": "clean", "reference_text": "a", "predicted_text": "b", "baseline_name": "x"}\n'
    )
    assert files.read_predictions(spark, str(tmp_path / "p.json")).first()["sample_id"] == "s1"
    with pytest.raises(ValueError, match="unsupported"):
        files.read_predictions(spark, str(tmp_path / "p.txt"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_predictions(spark, str(tmp_path / "none.csv"))


def test_validation(spark, tmp_path):
    (tmp_path / "p.csv").write_text("sample_id,condition\ns1,clean\n")
    with pytest.raises(ValueError, match="reference_text"):
        files.read_predictions(spark, str(tmp_path / "p.csv"))
    (tmp_path / "p.json").write_text('{"sample_id": "s1", "condition": "c", "reference_txt": "a", "predicted_text": "b", "baseline_name": "x"}\n')
    with pytest.raises(ValueError, match="reference_text"):
        files.read_predictions(spark, str(tmp_path / "p.json"))
    with pytest.raises(ValueError, match="no rows"):
        files.require_rows(spark.createDataFrame([], "a int"))


def test_texts_with_line_ends_come_back(spark, tmp_path):
    rows = [("s1", "clean", 'two\nlines, "quoted"', "", "x"), ("s2", "noisy", "one", " b ", "x")]
    files.write_rows(spark.createDataFrame(rows, schemas.PREDICTIONS), str(tmp_path / "rows.csv"))
    got = files.read_predictions(spark, str(tmp_path / "rows.csv")).collect()
    assert sorted((r["sample_id"], r["reference_text"]) for r in got) == [("s1", rows[0][2]), ("s2", "one")]


def test_truth_and_samples(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"a": {"reference_transcript": "x", "entities": {"dosages": ["5 mg"]}, "intent": "follow_up", "risk_flag": true},\n'
        ' "b": {"reference_transcript": "y", "intent": "other", "risk_flag": false}}'
    )
    truth = files.read_truth(spark, str(tmp_path / "t.json"))
    rows = {r["sample_id"]: r for r in truth.collect()}
    assert rows["a"]["entities"]["dosages"] == ["5 mg"] and rows["b"]["risk_flag"] is False
    (tmp_path / "s.json").write_text('[{"sample_id": "a", "target_keywords": []},\n {"sample_id": "c", "secondary_failure_mode": null}]')
    samples = files.read_samples(spark, str(tmp_path / "s.json"))
    assert [r["sample_id"] for r in J.join_truth(samples, truth).collect()] == ["a"]
    assert [r["sample_id"] for r in J.without_truth(samples, truth).collect()] == ["c"]


def test_bom_vocabulary_and_index(spark, tmp_path):
    head = "span,candidate,semantic_score,fuzzy_score,phonetic_score,word_count,contains_stopword,contains_digit,should_correct\n"
    (tmp_path / "g.csv").write_bytes(b"\xef\xbb\xbf" + head.encode() + b"x y,z,0.5,0.25,1,2,0,0,1\n")
    row = files.read_gate_training(spark, str(tmp_path / "g.csv")).first()
    assert row["span"] == "x y" and row["fuzzy_score"] == 0.25 and row["should_correct"] == 1
    (tmp_path / "v.txt").write_text("one\n\n  two  \n   \n")
    vocabulary = files.read_vocabulary(spark, str(tmp_path / "v.txt"))
    assert sorted(r["term"] for r in vocabulary.collect()) == ["one", "two"]
    (tmp_path / "i.json").write_text('{"terms": ["a", "b"],\n "embeddings": [[1.0, 0.0], [0.5, 0.5]]}')
    index = files.read_index_document(spark, str(tmp_path / "i.json"))
    files.write_index(index, str(tmp_path / "index"))
    assert {r["term"]: r["embedding"] for r in files.read_index(spark, str(tmp_path / "index")).collect()} == {
        "a": [1.0, 0.0], "b": [0.5, 0.5],
    }
    files.write_index(V.build_index(vocabulary), str(tmp_path / "sparse"))
    assert files.read_index(spark, str(tmp_path / "sparse")).count() == 6


def test_report_sink_is_one_file(spark, tmp_path):
    files.write_report(spark.range(100).repartition(5), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*"))) == 1


def test_shared_dir_is_kept(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_batch_evaluation_keeps_the_texts_of_error_rows_only(spark, tmp_path, monkeypatch):
    texts = ["take 10mg", 'said "no,\nfever"', "x y z", " lead", "one two three four five six seven"]
    rows = [(f"s{i}", "clean", t, t if i % 3 else t.replace("a", "o") + " more", f"b{i % 2}") for i, t in enumerate(texts * 24)]
    df = spark.createDataFrame(rows, "sample_id string, condition string, reference_text string, predicted_text string, baseline_name string")
    files.write_packed_rows(df.select(*schemas.PREDICTIONS.fieldNames()).coalesce(1), str(tmp_path / "rows.csv"), 50)
    assert len(list((tmp_path / "rows.csv").glob("part-*.gz"))) == 3
    kept = []
    monkeypatch.setattr(evaluation, "via_table", lambda df, label: kept.append(df) or df)
    summary = evaluation.batch_evaluation(spark, str(tmp_path / "rows.csv"), str(tmp_path / "report"), str(tmp_path / "errors"))
    want = scoring.score_predictions(df)
    errors = want.where("WER > 0.3 OR CER > 0.3")
    said = kept[0].where("reference_text IS NOT NULL")
    order = want.columns
    assert 0 < errors.count() < want.count() == kept[0].count()
    assert sorted(map(repr, said.select(order).collect())) == sorted(map(repr, errors.collect()))
    back = spark.read.options(header="true", escape='"', multiLine="true").csv(str(tmp_path / "errors"))
    assert sorted(r.sample_id for r in back.collect()) == sorted(r.sample_id for r in errors.collect())
    means = [F.round(m, 9).alias(m) for m in scoring.METRICS]
    told = [df.select("baseline_name", "condition", *means, "NumSamples").collect() for df in (summary, reports.summary(want))]
    assert sorted(told[0]) == sorted(told[1])


def test_salted_join_of_a_hot_key(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    joined = salted_join(big, small, "k", ["id"])
    assert joined.count() == 334 + 1
    assert salted_join(big, small, "k", ["id"], "left").count() == 1000


def test_salted_rows_are_sized_before_they_are_broadcast(spark):
    # 400,000 rows are below the limit of a broadcast, their 6,400,000 salted ones are not.
    big = spark.range(10_000_000).select("id", (F.col("id") % 1000).alias("k"))
    small = spark.range(400_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    plan = salted_join(big, small, "k", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


CHUNKS = [
    ("a", 1, 4, "take 10mg"), ("a", 0, 0, "hello  there"), ("b", 0, 2, ""), ("b", 1, 6, "no fever"),
    ("a", 2, 8, ""), ("b", 2, 90, "late words"), ("a", 3, 400, "again"),
]


def chunk_rows():
    start = dt.datetime(2024, 1, 1)
    return [(s, i, start + dt.timedelta(seconds=t), x) for s, i, t, x in CHUNKS]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(chunk_rows(), schemas.CHUNKS).cache()


def test_ingest_fills_in(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("", 2, None, "x")], schemas.CHUNKS)
    got = T.ingest(rows).collect()
    assert all(len(r["session_id"]) == 36 for r in got)
    assert got[0]["chunk_index"] == 0 and got[0]["normalized_text"] == ""
    again = T.ingest(rows.repartition(3)).collect()
    assert {r["session_id"] for r in again} == {r["session_id"] for r in got} and len({r["session_id"] for r in got}) == 2


def test_running_and_whole(chunks):
    ingested = T.ingest(chunks)
    running = {(r["session_id"], r["chunk_index"]): r for r in T.running_transcripts(ingested).collect()}
    assert running[("a", 1)]["session_raw_transcript"] == "hello  there take 10mg"
    assert running[("a", 3)]["session_corrected_transcript"] == "hello there take 10 milligrams  again"
    whole = {r["session_id"]: r["normalized_transcript"] for r in T.session_transcripts(ingested).collect()}
    assert whole == {"a": "hello there take 10 milligrams  again", "b": "no fever late words"}


def test_newest_sessions(spark):
    rows = [(f"s{i:03d}", i) for i in range(60)] + [("s000", 99)]
    kept = T.newest_sessions(spark.createDataFrame(rows, "session_id string, t int"), "t")
    assert {r["session_id"] for r in kept.collect()} == {f"s{i:03d}" for i in range(10, 60)}


def test_finalize(spark, chunks):
    transcripts = T.session_transcripts(T.ingest(chunks))
    requests = spark.createDataFrame([("a", "patient"), ("zz", "clinician")], "session_id string, audience string")
    index = V.build_index(spark.createDataFrame([("metformin",)], "term string"))
    got = {r["session_id"]: r for r in T.finalize(requests, transcripts, index).collect()}
    assert got["a"]["extraction"]["dosages"] == ["10 milligrams"] and got["a"]["prompt"].endswith("again")
    assert got["zz"]["normalized_transcript"] == "" and got["zz"]["extraction"] is None and got["zz"]["prompt"] is None
    assert got["zz"]["corrections"] == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The chunks in three files, read one per batch in the order of time."""
    path = tmp_path_factory.mktemp("chunks")
    import os
    import time as clock

    rows = sorted(chunk_rows(), key=lambda r: r[2])
    for n, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        out = path / f"raw{n}"
        spark.createDataFrame(part, schemas.CHUNKS).coalesce(1).write.parquet(str(out))
        target = path / f"part{n}.parquet"
        next(out.glob("part-*.parquet")).rename(target)
        os.utime(target, (clock.time() - 100 + n * 10,) * 2)
    return str(path)


def stream(spark, folder):
    return live.read_chunks(spark, folder, "part*.parquet", schemas.CHUNKS, per_batch=1)


def test_stream_running_over_batches(spark, folder):
    got = live.drain(live.running_transcripts(T.ingest(stream(spark, folder))), "t-running")
    rows = {(r["session_id"], r["chunk_index"]): r["session_raw_transcript"] for r in got.collect()}
    assert len(rows) == 7
    assert rows[("a", 3)] == "hello  there take 10mg  again" and rows[("b", 2)] == " no fever late words"


def test_stream_whole_equals_batch(spark, folder, chunks):
    want = {tuple(r) for r in T.session_transcripts(T.ingest(chunks)).collect()}
    got = live.drain_latest(T.session_transcripts(T.ingest(stream(spark, folder))), "session_id", "t-whole")
    assert {tuple(r) for r in got.collect()} == want


def test_staged_streams_give_all_that_batches_give(spark, chunks):
    rows = lambda df: {(r["session_id"], r["w"]["start"], r["text"]) for r in df.collect()}
    windows, delay = live.staged(chunks, 3)
    assert rows(live.drain(live.chunk_windows(windows, delay=delay), "t-windows")) == rows(T.chunk_windows(chunks))
    idle, delay = live.staged(chunks, 3)
    assert rows(live.drain(live.idle_sessions(idle, "1 minute", delay), "t-idle")) == rows(T.idle_sessions(chunks, "1 minute"))
    whole, delay = live.staged(T.ingest(chunks).select("session_id", "chunk_index", "ts", "normalized_text"), 3)
    want = {tuple(r) for r in T.session_transcripts(T.ingest(chunks)).collect()}
    assert {tuple(r) for r in live.drain(live.session_transcripts(whole, delay=delay), "t-whole").collect()} == want


def test_signal(spark):
    clips = [(1, [0.5, -0.25]), (2, [0.0, 0.0]), (3, [])]
    df = spark.createDataFrame(clips, "clip_id int, y array<float>")
    got = {r[0]: r[1] for r in df.select("clip_id", W.peak_normalize(F.col("y"))).collect()}
    assert got[1] == pytest.approx([0.95, -0.475]) and got[2] == [0.0, 0.0] and got[3] == []
    length = spark.createDataFrame([([1.0, 2.0, 3.0], 7, 5), ([1.0, 2.0, 3.0], 2, 5)], "n array<double>, l int, k int")
    fit = [r[0] for r in length.select(W.match_length(F.col("n"), F.col("l"), F.col("k"))).collect()]
    assert fit[0] == [1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 1.0] and fit[1] in ([1.0, 2.0], [2.0, 3.0])
    assert df.select(W.duration(F.col("y"), F.lit(0))).first()[0] == 0.0


def test_mixing_reaches_the_ratio(spark):
    rng = np.random.default_rng(0)
    c, n = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([(c.tolist(), n.tolist(), 10)], "c array<double>, n array<double>, db int")
    mixed = np.array(df.select(W.mix_snr(F.col("c"), F.col("n"), F.col("db"))).first()[0])
    assert 10 * np.log10(np.mean(c**2) / np.mean((mixed - c) ** 2)) == pytest.approx(10)


def test_dealing_does_not_depend_on_partitions(spark):
    clean = spark.range(200).select(F.col("id").alias("clip_id"), F.array(F.lit(1.0)).alias("samples"))
    noise = spark.range(7).select(F.col("id").alias("noise_id"), F.array(F.lit(0.5)).alias("noise"))
    deal = lambda df: {(r["clip_id"], r["noise_id"], r["snr_db"]) for r in A.assign_noise(df, noise).collect()}
    first = deal(clean)
    assert first == deal(clean.repartition(7)) and len(first) == 200 and len({n for _, n, _ in first}) == 7
    a = [r[0] for r in clean.select(W.gaussian_noise(F.col("clip_id"), F.col("samples"))).collect()]
    b = [r[0] for r in clean.repartition(3).orderBy("clip_id").select(W.gaussian_noise(F.col("clip_id"), F.col("samples"))).collect()]
    assert a == b
