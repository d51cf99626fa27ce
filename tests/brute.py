"""Plain Python restatements the Spark results are compared with."""

import re


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[j - 1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(previous[j - 1] + 1 if x == y else max(previous[j], row[j - 1]))
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def grams(text):
    padded = f" {text.lower()} "
    return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}


def cosine(a, b):
    return len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5


def best(span, terms, code, threshold):
    """Top three by trigrams, then by the weighted score; ties by term."""
    near = sorted(((cosine(span, t), t) for t in terms if grams(span) & grams(t)), key=lambda x: (-x[0], x[1]))[:3]
    scored = []
    for semantic, term in near:
        a, b = code[span], code[term]
        sound = ratio(a, b) if a and b else 0.0
        scored.append((0.5 * semantic + 0.3 * ratio(span, term) + 0.2 * sound, semantic, term))
    if not scored:
        return None
    top = max(scored, key=lambda x: (x[0], x[1]))
    return top[2] if top[0] >= threshold and top[2] != span else None


def chosen(runs):
    """Of runs (start, end, ..): the longest first, then the leftmost, as long as all their places are free."""
    free, kept = set(range(max((r[1] for r in runs), default=0))), []
    for run in sorted(runs, key=lambda r: (r[0] - r[1], r[0])):
        if free.issuperset(range(run[0], run[1])):
            free.difference_update(range(run[0], run[1]))
            kept.append(run)
    return kept


def rewritten(words, kept):
    """The words with each kept run (start, end, term) replaced by its term."""
    by_start = {start: (end, term) for start, end, term in kept}
    out, place = [], 0
    while place < len(words):
        place, word = by_start.get(place, (place + 1, words[place]))
        out.append(word)
    return " ".join(out)


def correct(text, choose, common):
    """All runs of one to four words whose term ``choose`` names, chosen and rewritten."""
    words = text.split()
    runs = []
    for start in range(len(words)):
        for end in range(start + 1, min(start + 4, len(words)) + 1):
            form = re.sub("[^a-zA-Z ]", "", " ".join(words[start:end])).strip().lower()
            rare = [w for w in form.split() if w not in common]
            if len(form.replace(" ", "")) >= 6 and 2 * len(rare) >= len(form.split()) and (term := choose(form)):
                runs.append((start, end, term))
    kept = chosen(runs)
    return rewritten(words, kept), len(kept)
