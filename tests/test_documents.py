import json
import random
from types import SimpleNamespace
from unittest.mock import MagicMock

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earshot import schemas
from earshot.sources import documents, files

ROW = "id long, text string, parts array<string>, deep struct<a: array<struct<b: string>>>"
TEXTS = ['plain', 'a, "quoted", one', "back\\slash\\", '\\"', "[{,}]", "line\nend, and\r\nmore", "é, ü", "", "]}", ",", '{"a": [1, 2]}', "x" * 300]


def records(count, seed=1):
    rng = random.Random(seed)
    return [
        {"id": i, "text": rng.choice(TEXTS), "parts": [rng.choice(TEXTS) for _ in range(rng.randrange(4))],
         "deep": {"a": [{"b": rng.choice(TEXTS)} for _ in range(rng.randrange(3))]}}
        for i in range(count)
    ]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    rows = records(80)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    schema = spark.createDataFrame([], ROW).schema
    assert documents.lines_of(spark, str(tmp_path / "a.json"), ",").rdd.getNumPartitions() > 10
    got = documents.read_json_array(spark, str(tmp_path / "a.json"), schema).collect()
    assert sorted((r.asDict(True) for r in got), key=lambda r: r["id"]) == rows


def test_keyed_objects_and_several_files(spark, tmp_path, small_splits):
    rows = {f'k"{r["id"]},': r for r in records(60, 2)}
    names = sorted(rows)
    for n in range(3):
        (tmp_path / f"{n}.json").write_text(json.dumps({k: rows[k] for k in names[n::3]}, ensure_ascii=False), encoding="utf-8-sig")
    (tmp_path / "none.json").write_text("{}")
    schema = spark.createDataFrame([], ROW).schema
    got = documents.read_json_object(spark, str(tmp_path), schema).collect()
    assert {r["key"]: r["value"].asDict(True) for r in got} == rows and len(got) == len(rows)


def test_empty_arrays_and_scalars(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ ] \n")
    (tmp_path / "b.json").write_text('[{"id": 1}, {"id": 2, "other": [1, 2]}]')
    schema = spark.createDataFrame([], "id long").schema
    assert sorted(r["id"] for r in documents.read_json_array(spark, str(tmp_path), schema).collect()) == [1, 2]


def test_arrays_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", None, TEXTS[i % len(TEXTS)]) for i in range(50)], "sample_id string, title string, text string")
    documents.write_json_arrays(rows.repartition(3), str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(part.read_text(encoding="utf-8")), list)
    got = files.read_samples(spark, str(tmp_path / "out")).select("sample_id", "title", "text")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert set(got.columns) <= set(schemas.SAMPLES.names) and got.where(F.col("title").isNotNull()).isEmpty()


def test_depths_count_every_character():
    for part in ("", "plain", '"a":1', '{"a":[1', '\\"]"', '"\\\\"}', 'x"[{"]', '\\\\"['):
        quoted, depth, turned = False, [0, 0], len(documents._ESCAPED.sub("", part).split('"')) % 2 == 0
        for c in documents._ESCAPED.sub("", part):
            quoted ^= c == '"'
            depth[quoted] += (c in "[{") - (c in "]}")
        assert documents._depths(part) == (turned, *depth)


@pytest.mark.parametrize("seed", range(5))
def test_marks_of_a_batch_are_those_of_its_parts(seed):
    """Quotes, escapes and brackets counted for all parts at once, in any slice of an array."""
    rng = random.Random(seed)
    parts = ["".join(rng.choices('ab"\\\\[]{}: \u00e9\U0001F600', k=rng.randrange(12))) for _ in range(300)]
    values = pa.array(["before", *parts, "after"], pa.string()).slice(1, len(parts))
    marks = documents._Marks(values)
    for begin in (False, True):
        turned, depth, want = begin, 0, []
        for part in parts:
            turns, *both = documents._depths(part)
            depth += both[turned]
            turned ^= turns
            want.append((turned, depth))
        assert want == list(zip(((marks.turns + begin) % 2 == 1).tolist(), marks.depth(begin).tolist()))


def test_entries_are_written_in_batches():
    """One batch of entries is one batch of lines, not one for each entry."""
    told = []
    entries = SimpleNamespace(mapInArrow=lambda f, schema: told.append(f) or MagicMock())
    documents._written(entries, "[]", "nowhere")
    batches = [pa.RecordBatch.from_pydict({"value": pa.array(x, pa.string())}) for x in (["1", "2", "3"], [], ["4"], ["5", "6"])]
    out = list(told[0](iter(batches)))
    assert [x for b in out for x in b.column(0).to_pylist()] == ["[1,", "2,", "3,", "4,", "5,", "6]"] and len(out) <= 5
    assert list(told[0](iter([]))) == []
