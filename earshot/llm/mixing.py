"""Mixing to target weights with soft domain membership, in DataFrame operations.

A table of labelled documents teaches which features speak for which domain: words, their
beginnings, and the shape of a text (shares of symbols, capitals, different words and repeated lines, word
length; in fixed steps). Every document then gets posteriors for all domains instead of one. Evidence of
features is not independent, so posteriors are calibrated: one half of the labelled
texts teaches the features, the other half counts how often each domain is behind
evidence of a kind (for which domain, how strong, or none). The mixture
is the nonnegative rate per document for which the expected tokens
of each domain, sum of tokens x posterior x rate, come closest to the targets:

    minimise  1/2 sum_k (share_k - target_k)^2 / natural_k
            + RIDGE / 2 sum_d weight_d (rate_d - 1)^2,   floor_d <= rate_d <= MAX_RATE

by projected gradient with Nesterov's momentum until the shares stand still. ``floor_d`` is 0, or 1 for documents whose likeliest domain
is to be kept whole (``KEPT``); the mixture is as large as that domain needs, and shares are of its size.
Each step is one aggregate of as many sums as there are
domains; the rates themselves never leave the executors.

The classifier is fitted on at most ``MAX_LABELLED`` labelled documents, those
with the smallest hash of their id, each different text once. A feature is evidence if its log odds are large and its shares
of texts many standard errors apart, at any size of the sample; all such features are used. They are
looked up inside the row in a table with two places for each, so none is lost to another; the table
grows with the features, whose number the bound on labelled documents bounds.
Tokens are words between blanks.

Rows that share a ``doc_id`` (null ids among them) are one document whose
tokens add up and whose posteriors are averaged. Null and empty texts have no tokens and no evidence: their
posteriors are those of documents without evidence, and their rate moves with those. Documents of equal posteriors
get equal rates, so ties and copies do too. Labels without a document, null
labels and a label table without rows are allowed; without labels there is one
prior for all. Without tokens at all every rate is 1; an empty table gives no rows. Very long texts are read whole, as one
array of words. Only ``doc_id`` and
``text`` are read, and ``doc_id``, ``quality``, ``toxic`` of the labels; other columns pass
through ``mixed_documents`` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import let
from earshot.llm.common import whole_rows
from earshot.session import via_table

# Domains of the labelled table and the share of tokens each is to have.
TARGETS = {"good": 0.95, "low": 0.03, "toxic": 0.02}
MAX_LABELLED = 20_000
PREFIXES = (4, 6)
# Steps of each measure of a text's shape; a text has one feature for each measure, the number of steps it has passed.
SHAPE = (
    ("characters between words to words", (1.3, 1.6, 2.0, 3.0)),
    ("different words to words", (0.1, 0.25, 0.4, 0.55)),
    ("runs of capitals to words", (0.05, 0.2, 0.5)),
    ("repeated lines to lines", (0.1, 0.3, 0.5)),
    ("letters and digits to words", (3.8, 4.4, 6.0, 7.5)),
)
CAPITALS = r"\p{Lu}{3,}"
# Log odds from which a feature is evidence, and by how many standard errors its shares of texts must differ: rare
# words differ between domains by chance.
MIN_LOG_ODDS = 2.0
MIN_ERRORS = 6.0
# The lookup table has so many places for a feature, and this many at least.
ROOM, MIN_SLOTS = 8, 1 << 10
# Sums of evidence that part its strength for calibration.
STRENGTHS = (3.0, 6.0, 12.0)
RIDGE = 1e-4
STEPS = 100
TOLERANCE = 2e-4
# A document is repeated so often at most: a domain that is nearly missing is not made up from a few texts.
MAX_RATE = 4.0
# The domain whose documents are all kept.
KEPT = "good"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``label_id, domain`` of at most ``limit`` labelled documents."""
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    told = one.select(F.col("doc_id").alias("label_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    return told.filter("domain IS NOT NULL").orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def shape_of(text: Column, words: Column, different: Column) -> Column:
    """One hash for each measure of ``SHAPE``: the measure and the number of steps it has passed. No words: none."""
    n = F.size(words)
    inside = F.char_length(F.array_join(words, ""))
    capitals = F.regexp_count(text, F.lit(CAPITALS))

    def repeated(lines: Column) -> Column:
        return 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    measures = ((F.char_length(text) - inside) / n, F.size(different) / n, capitals / n, let(lines, repeated), inside / n)

    def passed(m: Column, i: int, steps: tuple[float, ...]) -> Column:
        return F.xxhash64(F.lit(-1 - i), sum(((m >= s).cast("int") for s in steps), F.lit(0)))

    def told(m: Column) -> Column:
        return F.array(*(passed(m[i], i, steps) for i, (_, steps) in enumerate(SHAPE)))

    return F.when(n > 0, let(F.array(*measures), told)).otherwise(F.array().cast("array<bigint>"))


def features_of(text: Column) -> Column:
    """Hashes of the different words, of the beginnings of longer ones and of the text's shape. A beginning may come repeatedly."""
    def hashed(p: Column) -> Column:
        words = p["different"]
        starts = [F.transform(F.filter(words, lambda x: F.char_length(x) > n), lambda x: F.xxhash64(F.lit(n), F.substring(x, 1, n)))
                  for n in PREFIXES]
        return F.concat(F.transform(words, lambda x: F.xxhash64(F.lit(0), x)), *starts,
                        shape_of(F.coalesce(text, F.lit("")), p["words"], words))

    def parted(words: Column) -> Column:
        return F.struct(words.alias("words"), F.array_distinct(words).alias("different"))

    return let(let(F.array_remove(words_of(text), ""), parted), hashed)


def n_words(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("long")


def counts_of(sample: DataFrame, domains: list[str]) -> dict[str, int]:
    """Labelled documents of each domain."""
    n = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    return {d: n.get(d, 0) for d in domains}


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``domain, half, text`` of the labelled documents, each different text of a domain once, so that copies count once."""
    met = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    one = met.select("domain", "text", F.xxhash64("text").alias("key")).dropDuplicates(["domain", "key"])
    return one.select("domain", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(2)).cast("int").alias("half"), "text")


def evidence(taught: DataFrame, known: dict[str, int]) -> DataFrame:
    """``feature`` and one column of log odds per domain, for all features that tell domains apart.

    ``taught``: domain and text; ``known``: texts of each domain.
    """
    seen = taught.select("domain", F.explode(F.array_distinct(features_of(F.col("text")))).alias("feature"))
    shown = seen.groupBy("feature").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(known)))
    total = sum(known.values())
    all_ = sum((F.col(f"n_{i}") for i in range(len(known))), F.lit(0))

    def log_odds(i: int, d: str) -> Column:
        n, mine = known[d], F.col(f"n_{i}")
        rest = total - n
        odds = F.log(((mine + 0.5) / (n + 1.0)) / ((all_ - mine + 0.5) / (rest + 1.0)))
        if not n or not rest:
            return F.lit(0.0)
        apart = F.abs(mine / F.lit(n) - (all_ - mine) / F.lit(rest))
        error = F.sqrt(all_ / F.lit(total) * (1 - all_ / F.lit(total)) * (1 / n + 1 / rest))
        return F.when((F.abs(odds) >= MIN_LOG_ODDS) & (apart >= MIN_ERRORS * error) & (apart > 0), odds).otherwise(0.0)

    odds = shown.select("feature", *(log_odds(i, d).alias(f"w_{i}") for i, d in enumerate(known)))
    return odds.filter(F.greatest(*(F.abs(f"w_{i}") for i in range(len(known)))) > 0)


def _constant(values: list, kind: str) -> Column:
    """A constant array; the optimizer folds it into one object, so it costs an access by place."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def two_places(features: list[int]) -> tuple[int, dict[int, int]]:
    """The bits of a table, and which feature each place holds: every feature stands in one of its two places."""
    bits = max(MIN_SLOTS, ROOM * len(features)).bit_length()
    while True:
        mask, table = (1 << bits) - 1, {}
        for feature in features:
            at = feature & mask
            for _ in range(500):  # whoever held the place goes to its other one
                held = table.get(at)
                table[at] = feature
                if held is None:
                    break
                feature = held
                at = (feature & mask) ^ ((feature >> 32) & mask) ^ at
            else:
                break
        else:
            return bits, table
        bits += 1


def told_by(text: Column, odds: DataFrame, k: int) -> Column:
    """The evidence of a text for each domain, as an array. A feature speaks once, however often it is repeated.

    Evidence is looked up and added up inside the row: no row per word, no join.
    """
    rows = {r["feature"]: r for r in odds.collect()}  # bounded by the labelled documents
    if not rows:
        return F.array_repeat(F.lit(0.0), k)
    bits, table = two_places(sorted(rows))
    mask, size = (1 << bits) - 1, 1 << bits
    # An empty place holds a feature that stands nowhere near, so no feature equals it there.
    keys = _constant([table[b] if b in table else b ^ 1 for b in range(size)], "bigint")
    index = {feature: i for i, feature in enumerate(sorted(rows))}
    number = _constant([index[table[b]] if b in table else -1 for b in range(size)], "int")
    weights = [_constant([rows[f][f"w_{i}"] for f in index], "double") for i in range(k)]

    def first(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask)).cast("int")

    def second(x: Column) -> Column:
        return F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(mask)).cast("int")

    def known(x: Column) -> Column:
        return (F.get(keys, first(x)) == x) | (F.get(keys, second(x)) == x)

    def place(x: Column) -> Column:
        return F.get(number, F.when(F.get(keys, first(x)) == x, first(x)).otherwise(second(x)))

    def total(hits: Column, weight: Column) -> Column:
        return F.aggregate(hits, F.lit(0.0), lambda n, at: n + F.get(weight, at))

    def sums(hits: Column) -> Column:
        return F.array(*(total(hits, w) for w in weights))

    return let(F.transform(F.array_distinct(F.filter(features_of(text), known)), place), sums)


def kind_of(told: Column) -> Column:
    """The kind of evidence: 0 if none speaks for a domain, else the domain it speaks for most and how strongly."""
    def kind(e: Column) -> Column:
        most = F.array_max(e)
        level = sum(((most >= s).cast("int") for s in STRENGTHS), F.lit(0))
        return F.when(most > 0, 1 + (F.array_position(e, most).cast("int") - 1) * (len(STRENGTHS) + 1) + level).otherwise(F.lit(0))

    return let(told, kind)


def posteriors(labelled: DataFrame, domains: list[str]) -> list[list[float]]:
    """For each kind of evidence, the share of every domain behind it (``domain, kind``), smoothed by the shares over all."""
    k = len(domains)
    kinds = 1 + k * (len(STRENGTHS) + 1)
    n = {(r["kind"], r["domain"]): r["n"] for r in labelled.groupBy("kind", "domain").agg(F.count("*").alias("n")).collect()}
    whole = [1 + sum(n.get((j, d), 0) for j in range(kinds)) for d in domains]
    prior = [x / sum(whole) for x in whole]
    out = []
    for j in range(kinds):
        mine = [n.get((j, d), 0) + p for d, p in zip(domains, prior)]
        out.append([x / sum(mine) for x in mine])
    return out


def memberships(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """``doc_id, n_tokens`` and ``p_0 ..``: the posteriors in the order of ``domains``."""
    texts = via_table(labelled_texts(docs, via_table(labelled_sample(labels), "labelled")), "labelled-texts")
    teach, test = (texts.filter(F.col("half") == h) for h in (0, 1))
    kind = kind_of(told_by(F.col("text"), evidence(teach, counts_of(teach, domains)), len(domains)))
    table = posteriors(test.select("domain", kind.alias("kind")), domains)
    rows = docs.select("doc_id", n_words(F.col("text")).alias("n"), kind.alias("kind"))
    shares = (F.get(F.array(*(F.lit(float(p[i])) for p in table)), F.col("kind")) for i in range(len(domains)))
    return rows.select("doc_id", "n", *(p.alias(f"p_{i}") for i, p in enumerate(shares))).groupBy("doc_id").agg(
        F.sum("n").alias("n_tokens"), *(F.avg(f"p_{i}").alias(f"p_{i}") for i in range(len(domains))))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE,
              kept: int | None = None) -> DataFrame:
    """``members`` with ``rate``, by projected gradient on the written table.

    ``kept``: the domain whose documents (those for which it is the likeliest) have a rate of 1 at least. The mixture is so
    large that the domain's tokens fit into its target.
    """
    k = len(targets)
    p = [F.col(f"p_{i}") for i in range(k)]
    floor = F.lit(0.0) if kept is None else F.when(F.greatest(*p) == p[kept], 1.0).otherwise(0.0)
    state = via_table(members.withColumn("rate", F.lit(1.0)), "rates")
    total = state.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return state

    def shares(df: DataFrame, size: float) -> list[float]:
        share = (F.sum(F.col("n_tokens") * q * F.col("rate") / F.lit(size)) for q in p)
        return [float(x) for x in df.agg(*(s.alias(f"s_{i}") for i, s in enumerate(share))).first()]

    size = float(total)
    if kept is not None:
        size *= max(1.0, shares(state, size)[kept] / targets[kept])
        state = state.withColumn("rate", F.lit(size / total))
    start = shares(state, size)
    natural = [max(s, 1e-6) for s in start]
    before, now, whole = start, start, size / total
    state = state.withColumn("prior", F.col("rate"))
    eta = 1 / (1 + ridge)
    for step in range(1, steps + 1):
        # Nesterov's point ahead of the rates; its shares follow from those of the last two steps.
        ahead = (step - 1) / (step + 2)
        point = F.col("rate") + F.lit(ahead) * (F.col("rate") - F.col("prior"))
        slope = [(s + ahead * (s - r) - t) / m for s, r, t, m in zip(now, before, targets, natural)]
        moved = sum((F.lit(whole * eta * g) * q for g, q in zip(slope, p)), F.lit(0.0))
        next_ = F.lit(1 - eta * ridge) * point + F.lit(whole * eta * ridge) - moved
        state = state.select(*members.columns, F.least(F.lit(MAX_RATE), F.greatest(floor, next_)).alias("rate"), F.col("rate").alias("prior"))
        if step % 5 == 0:  # keeps the expression short
            state = via_table(state, "rates")
        before, now = now, shares(state, size)
        if max(abs(a - b) for a, b in zip(before, now)) < TOLERANCE * min(targets):
            break
    state = state.drop("prior")
    return via_table(state, "rates")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, n_tokens, p_<domain> .., rate`` of every document."""
    targets = targets or TARGETS
    whole = sum(targets.values())
    kept = list(targets).index(KEPT) if KEPT in targets else None
    fitted = fit_rates(memberships(docs, labels, list(targets)), [t / whole for t in targets.values()], kept=kept)
    return fitted.select("doc_id", "n_tokens", *(F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(targets)), "rate")


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies for a rate: rounded up with the probability of its fraction, by a hash of the id."""
    uniform = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(8)), 11) / F.lit(float(1 << 53))
    return F.floor(rate + uniform).cast("int")


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as often as its rate asks for, with all their columns."""
    rates = mix_rates(docs, labels, targets)
    taken = rates.select(F.col("doc_id").alias("rate_id"), copies(F.col("rate"), F.col("doc_id")).alias("copies"))
    joined = whole_rows(docs).join(taken.filter("copies > 0"), F.col("row.doc_id").eqNullSafe(F.col("rate_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
