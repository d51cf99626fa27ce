import hashlib
import random
import re

import pytest
from llm.cases import ODD, row

from earshot.llm import decontamination as dc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of each row."""
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in windows}:
            for i in range(len(w) - k + 1):
                got = windows.get(tuple(w[i:i + k]))
                if got:
                    hit.update(range(i, i + k))
                    found |= got
        names = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["Alpha", "beta,", "gamma!", "ünder", "x1"]) for _ in range(n)))
             for i, n in enumerate([12, 30, 10, 9, 4, 1, 25, 40])]
    items += [(2, "Some other text of item two, which has more words than ten and repeats an id"), (None, "an item that has no id at all"),
              (20, None), (21, ""), (22, " ,.- "), (23, items[1][1])]
    return items, spark.createDataFrame(items, "item_id long, text string")


def texts(items, rng, n):
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice(["alpha", "Beta", "x1", "other", "ünder", "gamma"]) for _ in range(rng.randint(0, 30)))]
        if i % 3 == 0:
            w = words(rng.choice(items)[1])
            parts.append(rng.choice([" ", "\n", ", "]).join(w[rng.randint(0, 5):]).upper())
        parts.append("tail words here")
        out.append(row(i, rng.choice([" ", " -- ", ""]).join(parts)))
    return out


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, make, benchmark, monkeypatch, limit):
    items, table = benchmark
    monkeypatch.setattr(dc.TestSet.__init__, "__defaults__", (dc.WINDOW, limit))
    rows = [*texts(items, random.Random(6), 60), *ODD, row(None, items[1][1]), row(None, items[0][1]), row(7, items[7][1])]
    got = sorted(map(tuple, dc.report(make(rows, clashing=True), table).collect()), key=repr)
    assert got == brute(rows, items) and any(r[2] for r in got)


def test_only_long_items_and_empty_tables(spark, make, benchmark, empty):
    items, table = benchmark
    long_items = [x for x in items if len(words(x[1])) >= 10]
    rows = texts(long_items, random.Random(7), 30)
    few = spark.createDataFrame(long_items, table.schema)
    assert sorted(map(tuple, dc.report(make(rows), few).collect()), key=repr) == brute(rows, long_items)
    assert dc.report(empty, table).count() == 0
    nothing = dc.report(make(rows), table.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r.contaminated or r.n_hit or r.n_items for r in nothing)


def test_spans_and_documents_go(spark, make):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [row(1, f"Before it. {passage.upper()}! After, it"), row(2, "  clean  text. "), row(3, passage), row(None, passage + " left"),
            row(None, "clean too"), row(5, None), row(6, " ..." + passage + "\n" + "kept " * 20 + passage), row(7, "..." * 1000 + passage)]
    docs = make(rows, clashing=True)
    cut = dc.decontaminate(docs, items)
    assert cut.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=repr)
    want = ["Before it. After, it", "  clean  text. ", "", "left", "clean too", None, " ..." + "kept " * 20, "..." * 1000]
    assert got == sorted(((r[0], t, None if t is None else len(t)) for r, t in zip(rows, want)), key=repr)
    assert all(not r.contaminated for r in dc.report(cut, items).collect())
    left = dc.decontaminate(docs, items, remove="documents")
    assert sorted((r.text for r in left.collect()), key=repr) == sorted(["  clean  text. ", "clean too", None], key=repr)
    assert dc.decontaminate(docs, items, remove="documents", max_share=0.8).count() == 5
    with pytest.raises(ValueError):
        dc.decontaminate(docs, items, remove="words")
