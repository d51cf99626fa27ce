import hashlib
import random

from llm.cases import ODD

from earshot.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    lines = {d: (t or "").split("\n") for d, t, *_ in rows}
    holders = {}
    for d, parts in lines.items():
        for line in parts:
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(d)
    out = {}
    for d, parts in lines.items():
        keep = [x for x in parts if len(h := holders.get(x.strip(BLANKS).translate(LOWER), ())) < 3 or max(h) == d]
        out[d] = (len(parts), len(parts) - len(keep), "\n".join(keep))
    return out


def report(docs):
    return {r[0]: (r[1], r[2], r[3]) for r in line_dedup.report(docs).collect()}


def hashed(want):
    return {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in want.items()}


def test_equals_brute_force(make):
    rng = random.Random(5)
    pool = [f"a line of some length number {i}" for i in range(12)] + ["short", "", "  ", "É" * 20, "é" * 20, " " + "x" * 20]
    rows = []
    for d in range(80):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 200 if d % 20 == 0 else 6))]
        parts = [rng.choice(["", " ", "\t", "\r"]) + (p.upper() if rng.random() < 0.3 else p) + rng.choice(["", " \x0b", "\r"]) for p in parts]
        rows.append((d * 3 % 80, "\n".join(parts)))
    assert report(make(rows)) == hashed(brute(rows))


def test_a_hot_line_stays_in_the_last_document(make):
    hot = "this very common line is in every document"
    rows = [(i, f"{hot}\nbut this line number {i} is its own\n{hot}") for i in range(500)]
    got = report(make(rows))
    assert got == hashed(brute(rows)) and got[499][1] == 0 and got[0][1] == 2


def test_odd_rows(odd, odd_clashing, empty, make):
    one = [r for r in ODD if r[0] is not None]
    assert report(make(one)) == hashed(brute(one))
    assert line_dedup.report(odd).count() == len(ODD) and line_dedup.report(empty).count() == 0
    kept = line_dedup.dedup_documents(odd_clashing)
    assert kept.columns == odd_clashing.columns and kept.schema.simpleString() == odd_clashing.schema.simpleString()
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))


def test_documents_carry_the_shorter_text(make):
    rows = [(i, f"repeated line of twenty and more\nown {i}") for i in range(4)]
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup_documents(make(rows)).collect()}
    assert got[0] == ("own 0", 5) and got[3] == (rows[3][1], len(rows[3][1]))


def test_rows_that_share_an_id_keep_their_own_lines(make):
    hot = "this very common line is in every document"
    rows = [(i, f"{hot}\nown line of document number {i}") for i in range(5, 9)]
    rows += [(d, t) for d in (None, 1) for t in (f"{hot}\nafter the common line in one text", f"a line that only the other text of {d} has\n{hot}")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_documents(make(rows)).collect() if r.doc_id in (None, 1))
    own = ["a line that only the other text of {} has", "after the common line in one text"]
    assert got == [(d or 0, x.format(d)) for d in (None, 1) for x in own]
    assert all(r.n_dropped == 1 for r in line_dedup.kept_texts(make(rows)).select("row.doc_id", "n_dropped").collect() if r.doc_id != 8)
