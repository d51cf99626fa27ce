"""Language identification, toxicity and mixing."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from llm.cases import ODD
from llm.toy import speak

from earshot.llm import language_id, mixing, toxicity
from earshot.llm.common import fold_of


def brute_bits(train, text, order=3):
    """Code length of a text by the definition, from dictionaries of contexts."""
    seen = [Counter() for _ in range(order + 1)]
    for t in train:
        data = [0] * order + [0xFF if b == 0 else b for b in t.encode()]
        for i in range(order, len(data)):
            for o in range(order + 1):
                seen[o][tuple(data[i - o:i]), data[i]] += 1
    contexts = [{} for _ in range(order + 1)]
    for o, counts in enumerate(seen):
        for (c, s), n in counts.items():
            contexts[o].setdefault(c, {})[s] = n

    def p(data, i, o):
        if o < 0:
            return 1 / 256
        after = contexts[o].get(tuple(data[i - o:i]))
        if not after:
            return p(data, i, o - 1)
        whole = sum(after.values()) + len(after)
        return after[data[i]] / whole if data[i] in after else len(after) / whole * p(data, i, o - 1)

    data = [0] * order + [0xFF if b == 0 else b for b in text.encode()]
    return sum(-math.log2(p(data, i, order)) for i in range(order, len(data)))


def trees_of(taught):
    counts = {}
    for lang, texts in taught.items():
        grams = Counter()
        for _, code, n in language_id._grams((lang, t) for t in texts):
            grams[code] += n
        counts[lang] = (np.array(list(grams), dtype=np.int64), np.array(list(grams.values()), dtype=np.int64))
    return language_id.CodeLengths(counts)


def assert_code_lengths(taught, texts):
    trees = trees_of(taught)
    got = trees.of(texts)
    for i, text in enumerate(texts):
        for j, lang in enumerate(trees.langs):
            assert got[i, j] == pytest.approx(brute_bits(taught[lang], text), rel=1e-4, abs=1e-3)
    return trees, got


@pytest.mark.parametrize("size", [50, language_id.SLICE])
def test_code_lengths_equal_the_definition(monkeypatch, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    rng = random.Random(1)
    taught = {lang: [speak(lang, rng, 30) for _ in range(5)] for lang in ("de", "en")}
    assert_code_lengths(taught, ["", "a", "the of", "ß\x00é€ zz", *(speak("de", rng, 40) for _ in range(5)), speak("en", rng, 200)])


def test_all_scripts_and_rare_contexts_count():
    """Eleven languages (two groups of tables), scripts that share no letter, most byte values, one rarely taught."""
    rng = random.Random(7)
    scripts = {f"l{i:02d}": [chr(c) for c in range(low, low + 24)] for i, low in enumerate(
        [0x61, 0xE0, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x4E00, 0xAC00])}

    def say(lang, n):
        return " ".join("".join(rng.choices(scripts[lang], k=rng.randint(2, 6))) for _ in range(n))

    taught = {lang: [say(lang, 6) for _ in range(1 if lang == "l10" else 6)] for lang in scripts}
    taught["l00"].append("".join(map(chr, range(1, 0x250))))
    taught["l01"].append("".join(chr(c) for c in range(0x1000, 0xFFFF, 251) if not 0xD800 <= c < 0xE000) + "\U0001f600\U000e0001\U00010000")
    assert len({b for texts in taught.values() for t in texts for b in t.encode()}) > 200
    texts = [say(lang, 8) for lang in scripts] + ["\U0001f600 new \U00020000", say("l03", 3) + say("l09", 3)]
    trees, got = assert_code_lengths(taught, texts)
    assert [trees.langs[b] for b in got[:11].argmin(axis=1)] == list(scripts)


def test_every_number_is_found():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        codes = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64) if n != 7 else np.arange(7) << 28).astype(np.uint32)
        places = language_id.Numbering(codes)
        assert (places.find(codes) == np.arange(len(codes))).all()
        other = np.setdiff1d(rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32), codes)
        assert (places.find(other) == -1).all()


def test_languages(make, odd_clashing, empty):
    rng = random.Random(2)
    rows = [(i, speak(lang, rng, rng.randint(3, 60)), lang, "s") for i in range(200) for lang in [("de", "en", "fr")[i % 3]]]
    rows += [(900, None, "en", "s"), (901, " 123 !", "en", "s"), (902, speak("de", rng, 20), None, None)]
    got = {r.doc_id: r for r in language_id.identify(make(rows)).collect()}
    held = [r for r in rows[:200] if fold_of(r[0]) == 2]
    assert all(got[r[0]].held_out == (fold_of(r[0]) == 2) and 0 <= got[r[0]].score <= 1 for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) > 0.95 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "de"
    # Held-out rows teach nothing: other languages on them change no prediction.
    other = make([r if fold_of(r[0]) != 2 else (*r[:2], "xx", r[3]) for r in rows])
    assert {r.doc_id: r.lang_pred for r in language_id.identify(other).collect()} == {d: r.lang_pred for d, r in got.items()}
    assert language_id.identify(odd_clashing).count() == len(ODD) and language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(make([(1, "words", None, "a")])).collect()} == {"und"}


def toxic_rows(rng, n):
    """Every group is named in both classes, but one of them mostly in toxic texts."""
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [speak("en", rng, 12) for _ in range(rng.randint(1, 5))]
        if rng.random() < (0.9 if bad else 0.05):
            text.append("so the women are " + speak("en", rng, 3))
        if bad:
            text.insert(rng.randint(0, len(text)), "you " + rng.choice(["vileword", "scumling", "scumlord"]) + " of")
        rows.append((i, ". ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(make, spark, odd_clashing, empty):
    rng = random.Random(3)
    rows, marks = toxic_rows(rng, 400)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    probes = [(10_000, "the women are here."), (10_001, "the men are here."), (10_002, "a scumling sat. Then the rest was fine"),
              (10_003, ""), (10_004, None)]
    docs = make(rows + probes)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [m for m in marks if fold_of(m[0]) == 2]
    assert sum(got[m[0]].predicted == m[2] for m in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert got[10_002].predicted == 1 and got[10_000].predicted == got[10_001].predicted == 0
    assert got[10_003].score == got[10_004].score

    def gap(penalty):
        weights, bias = toxicity.train(docs, labels, penalty)
        model = toxicity.Model(weights, bias)
        return abs(model.logit(probes[0][1]) - model.logit(probes[1][1]))

    assert gap(toxicity.PENALTY) < 0.5 * gap(0.0)
    other = spark.createDataFrame([(d, q, 1 - t if fold_of(d) == 2 else t) for d, q, t in marks], labels.schema)
    assert {r.doc_id: r.score for r in toxicity.score_documents(docs, other).collect()} == {d: r.score for d, r in got.items()}
    assert toxicity.score_documents(odd_clashing, labels).count() == len(ODD)
    assert toxicity.score_documents(empty, labels).count() == 0
    none = toxicity.score_documents(docs, labels.filter("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def brute_rates(tokens, p, targets, steps=mixing.STEPS, ridge=mixing.RIDGE, kept=None):
    total = size = tokens.sum()
    floor = np.zeros(len(tokens)) if kept is None else (p.argmax(axis=1) == kept).astype(float)
    if kept is not None:
        size = total * max(1.0, tokens @ p[:, kept] / total / targets[kept])
    whole = size / total
    rate = np.full(len(tokens), whole)
    shares = lambda r: (tokens * r) @ p / size
    natural = np.maximum(shares(rate), 1e-6)
    prior, before, now, eta = rate, natural, natural, 1 / (1 + ridge)
    for step in range(1, steps + 1):
        ahead = (step - 1) / (step + 2)
        point = rate + ahead * (rate - prior)
        slope = p @ ((shares(point) - targets) / natural)
        prior, rate = rate, np.clip(point - eta * (whole * slope + ridge * (point - whole)), floor, mixing.MAX_RATE)
        before, now = now, shares(rate)
        if np.abs(before - now).max() < mixing.TOLERANCE * min(targets):
            break
    return rate


def test_fit_reaches_the_optimum():
    """Momentum leads where many plain steps lead, also where the targets are out of reach."""
    rng = np.random.default_rng(8)
    for targets in ([0.95, 0.03, 0.02], [0.5, 0.4, 0.1]):
        p = rng.dirichlet([0.3, 0.01, 0.05], 300)
        tokens = rng.integers(1, 500, 300)
        fast = brute_rates(tokens, p, np.array(targets), kept=0)
        floor = (p.argmax(axis=1) == 0).astype(float)
        size = tokens.sum() * max(1.0, tokens @ p[:, 0] / tokens.sum() / targets[0])
        whole = size / tokens.sum()
        rate = np.full(300, whole)
        natural = np.maximum((tokens * rate) @ p / size, 1e-6)

        def cost(r, natural=natural, size=size, whole=whole, p=p, tokens=tokens, targets=targets):
            s = (tokens * r) @ p / size
            return ((s - targets) ** 2 / natural).sum() / 2

        for _ in range(20_000):
            slope = p @ (((tokens * rate) @ p / size - targets) / natural)
            rate = np.clip(rate - (whole * slope + mixing.RIDGE * (rate - whole)) / (1 + mixing.RIDGE), floor, mixing.MAX_RATE)
        assert cost(fast) <= cost(rate) + 1e-3


@pytest.mark.parametrize("kept, targets", [(None, [0.5, 0.4, 0.1]), (0, [0.5, 0.4, 0.1]), (0, [0.2, 0.5, 0.3])])
def test_rates_equal_projected_gradient(spark, kept, targets):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.1, 0.1, 0.1], 200)
    tokens = rng.integers(0, 500, 200)
    members = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))],
                                    "doc_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    got = mixing.fit_rates(members, targets, kept=kept).orderBy("doc_id").toPandas().rate.to_numpy()
    assert got == pytest.approx(brute_rates(tokens, p, np.array(targets), kept=kept), abs=1e-9) and (got >= 0).all()
    mixed = (tokens * got) @ p
    assert mixed / mixed.sum() == pytest.approx(targets, abs=0.02)
    if kept is not None:
        assert (got[p.argmax(axis=1) == kept] >= 1).all()


def brute_features(text):
    text = text or ""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    found = {("word", w) for w in words} | {(n, w[:n]) for w in words for n in mixing.PREFIXES if len(w) > n}
    if words:
        lines = [x for x in text.split("\n") if x.strip(" ")]
        inside = sum(map(len, words))
        shape = ((len(text) - inside) / len(words), len(set(words)) / len(words),
                 len(regex.findall(mixing.CAPITALS, text)) / len(words), 1 - len(set(lines)) / max(len(lines), 1), inside / len(words))
        found |= {(name, sum(m >= s for s in steps)) for m, (name, steps) in zip(shape, mixing.SHAPE)}
    return found


def brute_posteriors(texts, domains):
    """Posteriors of texts from taught ones ``(domain, half, text)``, by the definition."""
    taught = [(d, brute_features(t)) for d, half, t in texts if half == 0]
    known = Counter(d for d, _ in taught)
    shown = {d: Counter(f for e, fs in taught if e == d for f in fs) for d in domains}
    weights = {}
    for f in set().union(*(fs for _, fs in taught)):
        everywhere, total = sum(shown[d][f] for d in domains), sum(known.values())
        told = []
        for d in domains:
            n, mine = known[d], shown[d][f]
            rest = total - n
            odds = math.log(((mine + 0.5) / (n + 1)) / ((everywhere - mine + 0.5) / (rest + 1)))
            p = everywhere / total
            apart, error = abs(mine / n - (everywhere - mine) / rest), math.sqrt(p * (1 - p) * (1 / n + 1 / rest))
            told.append(odds if abs(odds) >= mixing.MIN_LOG_ODDS and apart >= mixing.MIN_ERRORS * error and apart > 0 else 0.0)
        if any(told):
            weights[f] = told

    def kind(text):
        sums = [sum(weights[f][i] for f in brute_features(text) if f in weights) for i in range(len(domains))]
        most = max(sums)
        return 0 if most <= 0 else 1 + sums.index(most) * 4 + sum(most >= s for s in mixing.STRENGTHS)

    seen = Counter((kind(t), d) for d, half, t in texts if half == 1)
    whole = [1 + sum(n for (_, e), n in seen.items() if e == d) for d in domains]
    prior = [x / sum(whole) for x in whole]

    def posterior(text):
        k = kind(text)
        mine = [seen[k, d] + q for d, q in zip(domains, prior)]
        return [x / sum(mine) for x in mine]

    return posterior, weights


def mixed_rows(n):
    """Three domains: plain texts, texts of symbols, repetitions or capitals, and texts with vile words."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        text = speak("en", rng, 30)
        if i % 4 == 2:
            text = [text.upper(), text.replace(" ", " # % "), " ".join([speak("en", rng, 1)] * 25), "\n".join([text] * 6)][i // 4 % 4]
        if i % 4 == 3:
            text += f" vileword{rng.randint(0, 2)}"
        rows.append((i, text, "en", "s"))
    return rows


N = 800


def test_posteriors_equal_brute_force(make, spark):
    rows = mixed_rows(N) + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, " ?! ", "en", "s")]
    rows += [(2000 + i, rows[3][1], "en", "s") for i in range(50)]  # copies teach once
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 != 2), int(r[0] % 4 == 3 or r[0] >= 2000)) for r in rows if r[0] % 3 or r[0] >= 1000],
                                   "doc_id long, quality int, toxic int")
    docs, domains = make(rows), list(mixing.TARGETS)
    taught = [tuple(r) for r in mixing.labelled_texts(docs, mixing.labelled_sample(labels)).collect()]
    assert len(taught) < labels.count() - 40
    posterior, weights = brute_posteriors(taught, domains)
    assert any(f[0] == "characters between words to words" for f in weights) and ("word", "vileword0") in weights
    got = {r.doc_id: [r.p_0, r.p_1, r.p_2] for r in mixing.memberships(docs, labels, domains).collect()}
    for doc_id, text, *_ in rows:
        assert got[doc_id] == pytest.approx(posterior(text), abs=1e-9), doc_id
    held = [r[0] for r in rows[:N] if r[0] % 3 == 0]
    low, good = ([got[i][1] for i in held if i % 4 in k] for k in ((2,), (0, 1)))
    assert np.mean(low) > 10 * np.mean(good)


def test_every_feature_has_its_place():
    rng = random.Random(3)
    for n in (0, 1, 500, 5000):
        features = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] + [rng.randrange(4) for _ in range(min(n, 2))]
        bits, table = mixing.two_places(sorted(set(features)))
        mask = (1 << bits) - 1
        assert sorted(table.values()) == sorted(set(features))
        assert all(at in (f & mask, (f >> 32) & mask) for at, f in table.items())


def test_mixture(make, spark, odd_clashing, empty):
    rows = mixed_rows(N)
    labels = spark.createDataFrame([(i, int(i % 4 != 2), int(i % 4 == 3)) for i in range(N) if i % 3] + [(9999, 1, 0), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix_rates(make(rows), labels).collect()}
    assert len(got) == N and all(r.p_good + r.p_low + r.p_toxic == pytest.approx(1) and r.rate >= 0 for r in got.values())
    assert np.mean([got[i].rate for i in range(N) if i % 4 == 3]) < 0.3 < 1 < np.mean([got[i].rate for i in range(N) if i % 4 < 2])
    total = sum(r.n_tokens * r.rate for r in got.values())
    for name, share in mixing.TARGETS.items():
        assert sum(r.n_tokens * r[f"p_{name}"] * r.rate for r in got.values()) / total == pytest.approx(share, abs=0.01)
    mixed = mixing.mixed_documents(make(rows, clashing=True), labels)
    assert mixed.columns == make(rows, clashing=True).columns
    n = Counter(r.doc_id for r in mixed.collect())
    assert all(n[i] >= 1 for i, r in got.items() if r.p_good >= max(r.p_low, r.p_toxic))
    assert all(abs(n[i] - got[i].rate) < 1 for i in got)
    one = {r.doc_id: r.rate for r in mixing.mix_rates(odd_clashing, labels).collect()}
    assert set(one) == {d for d, *_ in ODD}
    assert {r.rate for r in mixing.mix_rates(make([(1, None), (2, "")]), labels).collect()} == {1.0}
    assert mixing.mix_rates(empty, labels).count() == 0 and mixing.mixed_documents(empty, labels).count() == 0
    assert mixing.mix_rates(make(rows), labels.limit(0)).count() == N
