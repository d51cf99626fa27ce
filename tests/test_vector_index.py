"""The approximate search beside the exact one."""

import numpy as np
import pytest

from earshot.operators import retrieval as V
from earshot.operators import vector_index as I


def table(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, embedding array<double>")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [centres[0 if i % 3 else i % 12] + 0.4 * rng.normal(size=16) for i in range(900)]  # a hot cluster holds two thirds
    return [*rows, np.zeros(16)]


def test_recall_and_exact_scores(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 100)
    terms, queries = table(spark, [*rows, None], "term"), table(spark, [*rows[::7], None], "query_id")
    stored = I.write_vector_index(terms, str(tmp_path / "index"), cells=20)
    assert stored.vectors.count() == len(rows) and stored.cells.count() == 20
    assert stored.vectors.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 200
    unit = lambda df, key: df.where("embedding IS NOT NULL").select(key, V.normalized(df["embedding"]).alias("embedding"))
    exact = V.semantic_topk(unit(queries, "query_id"), unit(terms, "term"), 5).cache()
    scores = {(r.query_id, r.term): r.semantic_score for r in exact.collect()}
    found = I.approximate_topk(queries, I.read_vector_index(spark, str(tmp_path / "index")), 5).cache()
    assert I.recall(found, exact) >= 0.9
    assert all(scores[r.query_id, r.term] == pytest.approx(r.semantic_score) for r in found.collect() if (r.query_id, r.term) in scores)
    some = I.recall(I.approximate_topk(queries, stored, 5, probes=1), exact)
    every = I.approximate_topk(queries, stored, 5, probes=20).collect()
    assert some < 1 and {(r.query_id, r.place, round(r.semantic_score, 9)) for r in every} == {
        (r.query_id, r.place, round(r.semantic_score, 9)) for r in exact.collect()}


def test_probes_follow_the_data():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    tight = np.array([centres[i % 30] + 0.02 * rng.normal(size=24) for i in range(600)])
    loose = rng.normal(size=(600, 24))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (tight, loose)]
    few, many = (I.measured_probes(centres, x) for x in unit)
    assert few == 1 < many <= 30 and I.measured_probes(centres, unit[1], 0.5) < many and I.measured_probes(centres, unit[0][:1]) == 1


def test_empty_index(spark, rows, tmp_path):
    stored = I.write_vector_index(table(spark, rows[:1], "term").limit(0), str(tmp_path / "none"))
    assert I.approximate_topk(table(spark, rows[:3], "query_id"), stored, 2).count() == 0
