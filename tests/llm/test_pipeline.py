"""The pipeline stage by stage beside brute force, and the registration of all queries."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from llm.cases import SCHEMA, row
from llm.test_line_dedup import brute as without_lines
from llm.test_models import brute_rates
from llm.test_packing import check_places
from llm.test_quality import brute_kept
from llm.test_simhash import classes, fingerprint
from llm.toy import speak
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from earshot.llm import mixing


APART, SYMBOLS = 290, (310, 311, 312)


def similarity(a, b, size=5):
    """Jaccard similarity of the word shingles of two texts."""
    x, y = ({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def corpus(rng):
    """Clean texts, short and repetitive ones, shared lines, copies and near copies, toxic and null texts."""
    shared = "this whole line is shared by several documents"
    rows = []
    for i in range(160):
        text = "\n".join(speak("en", rng, 14) for _ in range(6))
        if i % 9 == 0:
            text += "\n" + shared
        if i % 10 == 3:
            text = "too short"
        if i % 17 == 4:
            text = "again and again " * 40
        if i % 4 == 1:
            text += " vileword here"
        rows.append(row(i, text, "en", f"host{i % 3}"))
    base = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(300))
    rows += [row(200 + i, base if i % 2 else base.replace(" v1", f" x{i}", 1), "en", "host1") for i in range(12)]
    rows += [row(300, None), row(301, ""), row(302, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(3000)))]
    words = base.split()
    rng2 = random.Random(99)
    for _ in range(6):
        words[rng2.randrange(len(words))] = f"y{rng2.randint(0, 10**6)}"
    rows.append(row(APART, " ".join(words), "en", "host1"))
    # Fail a soft rule only: symbols, in a host that is otherwise clean.
    rows += [row(d, " ".join(f"z{rng2.randint(0, 10**6)}" for _ in range(80)) + " #" * 70, "en", "host2") for d in SYMBOLS]
    labels = [(i, 1, int(i % 4 == 1)) for i in range(0, 160) if i % 5]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus(random.Random(12))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def stage(name, df):
        out = str(tmp_path / name)
        stages[name](spark, df, sf_dir).write.parquet(out)
        return spark.read.parquet(out)

    kept = stage("quality rules", docs)
    passes = brute_kept([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    rows = [(d, t) for d, t in rows if passes[d]]
    assert not any(passes[d] for d in SYMBOLS)
    assert texts(kept) == Counter(rows) and kept.columns == docs.columns

    kept = stage("line dedup", kept)
    rows = [(d, out[2]) for d, out in without_lines(rows).items()]
    assert texts(kept) == Counter(rows) and kept.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    kept = stage("near dedup", kept)
    group = classes({d: fingerprint(t) for d, t in rows})
    # What tells the stage from one by word similarity: a copy with some changed words is more bits away.
    apart = next(t for d, t in rows if d == APART)
    assert group[APART] == APART and similarity(apart, dict(rows)[211]) >= 0.8
    rows = [(d, t) for d, t in rows if group[d] == d]
    assert texts(kept) == Counter(rows) and kept.columns == docs.columns
    assert sum(200 <= d < 300 for d, _ in rows) < 12

    members = mixing.memberships(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"), list(mixing.TARGETS)).toPandas()
    targets = np.array(list(mixing.TARGETS.values()))
    members["rate"] = brute_rates(members.n_tokens.to_numpy(), members[["p_0", "p_1", "p_2"]].to_numpy(), targets / targets.sum(), kept=0)
    frame = spark.createDataFrame(members[["doc_id", "rate"]])
    times = {r["doc_id"]: r["n"] for r in frame.select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")).collect()}
    kept = stage("mixing", kept)
    clean = {d for d, t in rows if "vileword" not in t}
    rows = [x for x in rows for _ in range(times[x[0]])]
    assert texts(kept) == Counter(rows) and kept.columns == docs.columns
    assert len(clean) > 80 and clean <= {d for d, _ in rows}

    packed = stage("packing", kept).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            want[doc_id, i, low, high - low, crc32(ids[low:high].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    check_places(packed)
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in ran) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_an_empty_corpus_passes(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()
