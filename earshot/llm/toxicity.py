"""Toxicity by a counterfactually regularised classifier.

Features are lower-case words and their beginnings of four to eight letters; a word's
share in the score is the sum of its features' weights, a sentence's logit is the
bias plus its words, and a text scores as its worst sentence.

Training: (1) one distributed aggregate counts, over all labelled documents outside the
held-out fold, in how many of either class a feature is; at most
``MAX_FEATURES`` features with clear log odds go on. (2) Of at most
``MAX_LABELLED`` labelled documents, those with the smallest hash of their id,
each sentence is reduced to its features. (3) Weights are fitted by gradient
descent on the documents' worst sentences, chosen anew every round. Identity terms in the labelled sentences
are swapped for other terms of the lexicon (a sentence without one gets one,
so that all terms are compared), and the squared change of the logit
is a penalty: naming a group must not move the score. Terms start with the weights
that their documents suggest, so without the penalty they would keep them.

Null and empty texts score as the bias alone. Labels that are null or have
no document teach nothing; a document with several labels counts as toxic if
any says so. If one class has no labelled document, every score is 0.
Rows are scored one by one, so ties and repeated rows get equal answers; an
empty table gives no rows. Only ``doc_id`` and ``text`` of the documents are
read, and ``doc_id`` and ``toxic`` of the labels.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import fold, per_text
from earshot.session import via_table

THRESHOLD = 0.3
MAX_LABELLED = 20_000
MAX_FEATURES = 20_000
PREFIXES = (4, 5, 6, 7, 8)
# Documents of either class that show a feature, and its least log odds.
MIN_SHOWING = 3
MIN_LOG_ODDS = 1.0
# Rounds of choosing worst sentences, steps of each, step size, weight decay and counterfactual penalty.
ROUNDS = 4
STEPS = 150
STEP = 0.5
DECAY = 1e-3
PENALTY = 5.0

# Neutral names of groups, in sets whose members are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_WORKER_WORDS = 300_000


def features(word: str) -> list[str]:
    """The word and its beginnings, which are marked so that they are not taken for words."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence that has any."""
    found = (_WORD.findall(s) for s in _SENTENCE.split(text.lower()))
    return [words for words in found if words]


def _document_features(rows: Iterator[tuple]) -> Iterator[tuple]:
    for toxic, text in rows:
        yield toxic, sorted({f for w in set(_WORD.findall((text or "").lower())) for f in features(w)})


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, text`` of the labelled documents outside the held-out fold."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    taught = one.filter(fold(F.col("label_id")) != 2).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED)
    return docs.select("doc_id", "text").join(F.broadcast(taught), F.col("doc_id") == F.col("label_id")).select(
        "doc_id", "toxic", "text")


def informative(taught: DataFrame, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Features with clear log odds, and those."""
    shown = per_text(taught, ["toxic", "text"], "toxic int, features array<string>", _document_features).select(
        "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n_clean + 1.0))
    told = shown.filter(F.col("n") >= MIN_SHOWING).withColumn("odds", odds).filter(F.abs("odds") >= MIN_LOG_ODDS)
    top = told.orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "feature").limit(MAX_FEATURES)
    return {r["feature"]: r["odds"] for r in top.collect()}


def counterfactuals(words: list[str], turn: int) -> tuple[str, str]:
    """An identity term of the sentence, or one put into it, and the term it is swapped for."""
    for terms in IDENTITY_TERMS:
        for word in words:
            if word in terms:
                others = [t for t in terms if t != word]
                return word, others[turn % len(others)]
    terms = IDENTITY_TERMS[turn % len(IDENTITY_TERMS)]
    return terms[turn // len(IDENTITY_TERMS) % len(terms)], terms[(turn // len(IDENTITY_TERMS) + 1) % len(terms)]


class Model:
    """Weights of features and the bias."""

    _shared: dict[str, Model] = {}

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words: dict[str, float] = {}

    @classmethod
    def shared(cls, key: str, weights: dict[str, float], bias: float) -> Model:
        if key not in cls._shared:
            cls._shared = {key: cls(weights, bias)}
        return cls._shared[key]

    def word(self, word: str) -> float:
        if word not in self.words:
            if len(self.words) >= _WORKER_WORDS:
                self.words.clear()
            self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return self.words[word]

    def logit(self, text: str | None) -> float:
        """The bias and the worst sentence."""
        worst = None
        for words in sentences(text or ""):
            told = sum(map(self.word, words))
            worst = told if worst is None else max(worst, told)
        return self.bias + (worst or 0.0)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.logit(text)))))


def fit(bags: list[tuple[int, list[list[int]], list[tuple[list[int], list[int]]]]], start: np.ndarray,
        penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias from documents: label, feature numbers of each sentence, and counterfactual pairs of features.

    Classes weigh the same in sum, so that a rare class is not outvoted.
    """
    label = np.array([b[0] for b in bags], dtype=float)
    share = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    pairs = [p for b in bags for p in b[2] if p[0] or p[1]]
    pair_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, int)
    pair_at = np.array([f for a, b in pairs for f in a + b], dtype=int)
    pair_sign = np.array([s for a, b in pairs for s in [1.0] * len(a) + [-1.0] * len(b)])
    weights, bias = start.copy(), 0.0
    rate = np.full(len(start) + 1, 1e-8)
    for _ in range(ROUNDS):
        worst = [max(b[1], key=lambda s: sum(weights[f] for f in s), default=[]) for b in bags]
        row = np.repeat(np.arange(len(worst)), [len(s) for s in worst])
        at = np.array([f for s in worst for f in s], dtype=int)
        for _ in range(STEPS):
            logit = bias + np.bincount(row, weights[at], minlength=len(worst))
            wrong = share * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - label)
            slope = np.bincount(at, wrong[row], minlength=len(weights)) + DECAY * weights / max(len(weights), 1)
            if len(pairs):
                change = np.bincount(pair_row, pair_sign * weights[pair_at], minlength=len(pairs))
                slope += penalty / len(bags) * np.bincount(pair_at, pair_sign * change[pair_row], minlength=len(weights))
            both = np.append(slope, wrong.sum())
            rate += both ** 2
            move = STEP * both / np.sqrt(rate)
            weights -= move[:-1]
            bias -= move[-1]
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> tuple[dict[str, float], float] | None:
    """Weights and bias learned from the labelled documents; None if a class is missing."""
    taught = via_table(labelled(docs, labels), "labelled")
    n = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    odds = informative(taught, n[0], n[1])
    names = sorted(odds)
    number = {f: i for i, f in enumerate(names)}

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        def known(words: list[str]) -> list[int]:
            return [number[f] for w in words for f in features(w) if f in number]

        for doc_id, toxic, text in source:
            parts = sentences(text or "")
            told = {tuple(k) for k in map(known, parts) if k}
            swaps = [counterfactuals(words, doc_id + i) for i, words in enumerate(parts[:1] if not told else parts)]
            pairs = {(tuple(known([a])), tuple(known([b]))) for a, b in swaps}
            yield (int(toxic), [list(t) for t in sorted(told)] + ([[]] if len(told) < len(parts) or not parts else []),
                   [[list(a), list(b)] for a, b in sorted(pairs) if a or b])

    schema = "toxic int, parts array<array<int>>, pairs array<array<array<int>>>"
    collected = per_text(taught, ["doc_id", "toxic", "text"], schema, rows).collect()  # at most MAX_LABELLED rows
    bags = sorted((r["toxic"], r["parts"], [tuple(p) for p in r["pairs"]]) for r in collected)
    weights, bias = fit(bags, np.array([odds[f] for f in names]) / 2, penalty)
    return dict(zip(names, weights.tolist())), float(bias)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        judge = Model.shared(key, *held.value) if held.value else None
        for doc_id, held_out, text in source:
            score = judge.score(text) if judge else 0.0
            yield doc_id, held_out, score, int(score >= threshold)

    marked = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return per_text(marked, ["doc_id", "held_out", "text"],
                    "doc_id long, held_out boolean, score double, predicted int", rows, 10_000)
