"""Quoted line ends across splits, beside the built-in reader."""

import random

import pyarrow as pa
import pytest

from earshot.sources import files, records

CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def written(rng, n):
    """CSV with quoted line ends, doubled quotes, empty and unquoted values."""
    def value():
        kind = rng.randint(0, 5)
        text = "".join(rng.choice(["a", "b", " ", ",", "\n", '""', "é", "x\n\ny"]) for _ in range(rng.randint(1, 60)))
        return f'"{text}"' if kind < 3 else f"plain {rng.randint(0, 99)}" if kind < 5 else ""

    return "id,first,second\n" + "".join(f"{i},{value()},{value()}\n" for i in range(n))


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_rows_equal_the_built_in_reader(spark, tmp_path, size):
    rng = random.Random(size)
    (tmp_path / "a.csv").write_text(written(rng, 400), encoding="utf-8")
    (tmp_path / "b.csv").write_text(written(rng, 30) + '999,"one\n' + "long line\n" * 200 + '",end\n', encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        splits = records._splits(records._lines(spark, str(tmp_path))).count()
        got = sorted(map(tuple, records.read_quoted_csv(spark, str(tmp_path)).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert splits > (20 if size == 300 else 1)
    want = sorted(map(tuple, spark.read.options(**CSV).csv(str(tmp_path)).collect()), key=repr)
    assert got == want and len(got) == 431


def test_json_names_without_a_second_read(spark, tmp_path):
    path = str(tmp_path / "p.json")
    names = [f.name for f in files.schemas.PREDICTIONS.fields]
    row = "{" + ", ".join(f'"{n}": "v"' for n in names) + "}"
    (tmp_path / "p.json").write_text(row + "\n{broken\n")
    assert files.read_predictions(spark, path).count() == 2
    late = "{" + ", ".join(f'"{n}": "v"' for n in names[:-1]) + "}\n"
    (tmp_path / "late.json").write_text(late * 150 + row + "\n")
    assert files.read_predictions(spark, str(tmp_path / "late.json")).count() == 151
    (tmp_path / "bad.json").write_text(late * 3)
    with pytest.raises(ValueError, match="missing required columns"):
        files.read_predictions(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_lines_are_joined_a_batch_at_a_time(size):
    """Records of two splits, the second of which begins inside quotes, in batches of any size."""
    rng = random.Random(size)
    text = written(rng, 120).rstrip("\n")
    lines = text.split("\n")
    half = next(i for i in range(len(lines) // 2, len(lines)) if "\n".join(lines[:i]).count('"') % 2)
    rows = [(1 + (i >= half), i < half, i >= half, line) for i, line in enumerate(lines)]
    parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=["split", "head", "inside", "value"])
             for i in range(0, len(rows), size)]
    got = [(split, kind, t) for split, _, kind, texts in records._records(iter(parts)) for t in texts.to_pylist()]
    assert [k for _, k, _ in got if k != records.WHOLE] == [records.BEGIN, records.END]
    first, second = ([t for s, _, t in got if s == n] for n in (1, 2))
    joined = [*first[:-1], first[-1] + "\n" + second[0], *second[1:]]
    assert "\n".join(joined) == text.split("\n", 1)[1]  # the header is left out
    assert all(t.count('"') % 2 == 0 for t in joined)


def test_lines_that_are_records_pass_as_they_come():
    lines = pa.array([f'{i},"a ""b"""' for i in range(1000)])
    part = pa.RecordBatch.from_arrays([pa.array([1] * 1000), pa.array([False] * 1000), pa.array([False] * 1000), lines], names=["split", "head", "inside", "value"])
    assert [t for *_, t in records._records(iter([part, part]))] == [lines, lines]


def test_only_splits_that_records_cross_are_read_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n" + '1,"two\nlines"\n' * 40)
    assert [r.cut for r in records._splits(records.lines_of(spark, str(tmp_path))).collect()] == [False]
