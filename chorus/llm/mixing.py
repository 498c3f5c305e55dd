"""Mixing to target weights with soft domain membership (operator 1).

A classifier learnt from a labelled table gives every document a posterior over
domains. Documents get nonnegative rates, how often a pass over the corpus should
use them, such that the expected tokens per domain, the sum of rate x tokens x
posterior, match the targets:

    minimise  1/2 |sum_i r_i t_i p_i - b|^2 in the norm W,  r_i >= 0,  from r_i = 1,

with W the inverse of sum t_i p_i p_i' plus a little in every direction. Of rates that match alike those nearest to 1
count, by a term of weight ``NEARNESS``. Gradients are scaled by the inverse of a
document's tokens and summed before they are projected, so the rate follows from the
posterior and one price per domain, r_i = max(0, 1 - p_i x prices). A step divides the
gradient by the Gram matrix of the rows that are at no bound now. One iteration is one
pass over the staged posteriors, which sums a small vector for each of the step lengths
tried; the best of them is taken. The passes end when the projected gradient is below
``TOLERANCE``; if ``ITERATIONS`` of them do not get there, ``fit_rates`` raises.

With weights a rate is at most ``MOST_RATE``, so a rare domain cannot ask for thousands of
copies of a text. What expected tokens then differ from the targets is part of the result
(``missed_`` and the domain, in tokens), and a warning if it is over ``MISSED`` of them all.

``CLEANING`` instead of weights removes what is not good: its targets come from the
expected tokens measured in the input. Documents classed good (no domain has a larger
posterior) have a rate of at least 1, the others of at most 1. Good keeps its tokens.
Toxic gets what documents classed good carry of it, and poor at most ``MOST_POOR`` times
the good tokens, but neither less than documents classed good carry when they stand in
for all good tokens, nor more than there is.

The classifier counts word starts, word ends and word shapes in a bounded sample
of labelled rows (``SAMPLE`` rows a class) and keeps those that one class has far
more often than the others. How many of them a text holds per class, and plain
statistics of its words, enter a softmax regression fitted on the other half of
the sample.
Tokens are words between white space.

Defined results: a null or empty text has no tokens and a posterior from the
class priors; unlabelled rows only take part in the mixing; label rows that
repeat an id count once, with the worst of their values; without labels every
document belongs to ``good``; repeated rows get equal rates; an empty table gives
an empty result. A missing id draws like any other value.
"""

from __future__ import annotations

import operator
import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chorus.llm.common import stage, tuples, utf8

DOMAINS = ("good", "poor", "toxic")
SAMPLE = 1600
LEAST_DOCUMENTS = 4
LEAST_ODDS = 6.0
MOST_FEATURES = 60_000
ITERATIONS = 60
TOLERANCE = 1e-6  # of the projected gradient, as a share of all tokens
NEARNESS = 1e-6
MOST_RATE = 64.0  # with weights
MISSED = 0.01
LEAST_NORM = 1e-3
LENGTHS = 4.0 ** -np.arange(8)

CLEANING = "cleaning"
MOST_POOR = 0.055 / 0.93

_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


def word_features(word: bytes) -> tuple[bytes, ...]:
    """The start of a word at several lengths, its end and its shape."""
    letters = _LETTERS.search(word) is not None
    shape = (b"^u" if letters and word == word.upper() and word != word.lower() else
             b"^l" if letters else b"^s")
    start = b"<" + word[:7].lower()
    return (start[:5], start[:6], start, b">" + word[-3:], shape + b"%d" % min(len(word), 24))


def features(text: bytes | None) -> set[bytes]:
    return {f for w in set((text or b"").split()) for f in word_features(w)}


class Classifier:
    """Telling features, text statistics and a softmax over both; small, whatever the corpus."""

    def __init__(self, telling: dict[bytes, int], prior: np.ndarray):
        self.telling, self.prior = telling, prior
        self.mean = self.spread = self.slopes = None
        self._words: dict[bytes, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_words": {}}

    def _word(self, word: bytes) -> tuple:
        """Known features and whether a word is upper-case, letterless, oddly ended."""
        last = word[-1:]
        return (tuple(f for f in word_features(word) if f in self.telling),
                len(word) > 1 and word.upper() == word != word.lower(),
                _LETTERS.search(word) is None,
                not (last.isalnum() or last >= b"\x80" or last in b".,"))

    def statistics(self, text: bytes | None) -> np.ndarray:
        """Features found per domain, and repetition, case, signs and length of a text."""
        words = (text or b"").split()
        counts = Counter(words)
        if len(self._words) > 200_000:
            self._words = {}
        seen, known, upper, bare, odd = self._words, set(), 0, 0, 0
        for w, n in counts.items():
            found = seen.get(w)
            if found is None:
                found = seen[w] = self._word(w)
            known.update(found[0])
            upper += n * found[1]
            bare += n * found[2]
            odd += n * found[3]
        hits = np.zeros(len(DOMAINS))
        for f in known:
            hits[self.telling[f]] += 1
        n, distinct = max(len(words), 1), max(len(counts), 1)
        again = sum(map(operator.eq, words, words[1:]))
        return np.r_[np.log1p(hits), hits / distinct, distinct / n,
                     max(counts.values(), default=0) / n, upper / n, bare / n, odd / n, again / n,
                     np.log1p(len(words)), 1.0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Softmax regression by gradient steps; classes weigh as in the whole label table."""
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.mean[-1], self.spread[-1] = 0.0, 1.0
        z, wanted = (x - self.mean) / self.spread, np.eye(len(DOMAINS))[y]
        share = self.prior / self.prior.sum() / np.maximum(wanted.mean(axis=0), 1e-9)
        weight = share[y][:, None]
        slopes = np.zeros((x.shape[1], len(DOMAINS)))
        speed = np.zeros_like(slopes)
        for _ in range(3000):
            down = z.T @ (weight * (softmax(z @ slopes) - wanted)) / len(z) + 1e-4 * slopes
            speed = 0.9 * speed - 0.2 * down
            slopes = slopes + speed
        self.slopes = slopes

    def posteriors(self, statistics: np.ndarray) -> np.ndarray:
        if self.slopes is None:  # nothing to learn from
            share = self.prior if self.prior.sum() else np.eye(len(DOMAINS))[0]
            return np.tile(share / share.sum(), (len(statistics), 1))
        return softmax(((statistics - self.mean) / self.spread) @ self.slopes)

    def of_texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Posterior over domains of each text."""
        if not texts:
            return np.zeros((0, len(DOMAINS)))
        return self.posteriors(np.array([self.statistics(t) for t in texts]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def domain_of() -> Column:
    """Domain of a label row: toxic before poor before good."""
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
            .when(F.col("quality") == 1, "good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
        text_col: str = "text") -> Classifier:
    """Learn from about ``SAMPLE`` labelled rows a domain, chosen by a hash of the id."""
    worst = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
             .withColumn("domain", domain_of()).filter(F.col("domain").isNotNull())
             .select("id", "domain", F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 30)).alias("u")))
    sizes = {r["domain"]: r["count"] for r in worst.groupBy("domain").count().collect()}
    prior = np.array([sizes.get(d, 0) for d in DOMAINS], float)
    if not prior.sum():
        return Classifier({}, prior)
    share = F.lit(0.0)
    for domain, n in sizes.items():
        share = F.when(F.col("domain") == domain, min(1.0, SAMPLE / n) * (1 << 30)).otherwise(share)
    sample = stage(worst.filter(F.col("u") < share)
                   .select("id", "domain", (F.col("u") % 2).cast("int").alias("half")), "mix-sample")
    rows = (docs.filter(F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t"))
            .join(sample, "id"))
    texts = stage(rows.select("t", "domain", "half"), "mix-texts")

    def found(batch, _):
        counts = Counter((d, f) for t, d in zip(*(c.to_pylist() for c in batch.columns))
                         for f in features(t))
        return {"domain": [d for d, _ in counts], "feature": [f for _, f in counts],
                "n": list(counts.values())}

    learnt = texts.filter("half = 0").select("t", "domain")
    totals = {r["domain"]: r["count"] for r in learnt.groupBy("domain").count().collect()}
    counted = (tuples(learnt, found, "domain string, feature binary, n long")
               .groupBy("feature").pivot("domain", list(DOMAINS)).agg(F.sum("n")).na.fill(0))
    rates = F.array(*[(F.col(d) + 0.25) / (totals.get(d, 0) + 0.5) for d in DOMAINS])
    telling = (counted.select("feature", rates.alias("rates"),
                              F.greatest(*DOMAINS).alias("most"))
               .withColumn("best", F.array_max("rates"))
               .filter((F.col("most") >= LEAST_DOCUMENTS)
                       & (F.col("best") >= LEAST_ODDS * F.element_at(F.array_sort("rates"), -2)))
               .select("feature", "most", F.array_position("rates", F.col("best")).alias("domain"))
               .orderBy(F.desc("most"), "feature").limit(MOST_FEATURES))
    model = Classifier({bytes(r["feature"]): r["domain"] - 1 for r in telling.toLocalIterator()},
                       prior)

    def scored(batch, own):
        return {"domain": batch.column(1),
                "x": [own.statistics(t).tolist() for t in batch.column(0).to_pylist()]}

    held = tuples(texts.filter("half = 1").select("t", "domain"), scored,
                  "domain string, x array<double>", lambda: model).collect()
    if held:
        model.calibrate(np.array([r["x"] for r in held]),
                        np.array([DOMAINS.index(r["domain"]) for r in held]))
    return model


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, _):
        texts = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "tokens": [len((t or b"").split()) for t in texts],
                "p": shared.value.of_texts(texts).tolist()}

    return tuples(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")),
                  run, "doc_id long, tokens long, p array<double>")


def replay(p: np.ndarray, prices: np.ndarray, cleaning: bool = False) -> np.ndarray:
    """Rates at the prices of the domains, projected onto their bounds."""
    return np.clip(1.0 - p @ prices, *bounds(p, cleaning))


def bounds(p: np.ndarray, cleaning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest rate of each row."""
    if not cleaning:
        return np.zeros(len(p)), np.full(len(p), MOST_RATE)
    good = classed_good(p)
    return good.astype(float), np.where(good, np.inf, 1.0)


def classed_good(p: np.ndarray) -> np.ndarray:
    return p.argmax(axis=1) == 0


def cleaning_targets(have: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Tokens per domain from those there are and those documents classed good carry."""
    stand_in = carried * (have[0] / carried[0] if carried[0] else 1.0)
    return np.minimum(have, np.maximum(stand_in, have[0] * np.array([1.0, MOST_POOR, 0.0])))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(DOMAINS))


def _sums(rows: DataFrame, fn) -> np.ndarray:
    """Sum over all rows of vectors made per batch; each task sends one row."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = fn(_matrix(batch, "p"), batch.column(0).to_numpy().astype(float))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()),
                                              "x": pa.array(total, pa.float64())})

    parts = (rows.select("tokens", "p").mapInArrow(run, "at int, x double")
             .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect())
    return np.array([r["x"] for r in parts])


def fit_rates(rows: DataFrame, weights: dict[str, float] | str, total: float | None = None,
              spare: float = 1.0) -> np.ndarray:
    """Prices of the domains at the optimum, see ``solve_rates``."""
    return solve_rates(rows, weights, total, spare)[0]


def solve_rates(rows: DataFrame, weights: dict[str, float] | str, total: float | None = None,
                spare: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Prices of the domains at the optimum and by how many tokens each misses its target;
    ``rows`` has tokens and p.

    ``weights`` are target shares, or ``CLEANING``, which has no budget of its own.
    ``total`` is the token budget of the mixture. Without it the largest domain of
    ``weights`` keeps its expected tokens, times ``spare``. Raises if the optimum is
    not reached.
    """
    d = len(DOMAINS)
    prices = np.zeros(d)
    found = _sums(rows, lambda p, t: np.r_[t @ p, (t * classed_good(p)) @ p,
                                           ((p * t[:, None]).T @ p).ravel()])
    have, carried = found[:d], found[d:2 * d]
    scale = have.sum()
    if not scale:
        return prices, np.zeros(d)
    cleaning = weights == CLEANING
    if cleaning:
        target = cleaning_targets(have, carried) / scale
    else:
        share = np.array([weights.get(x, 0.0) for x in DOMAINS])
        share = share / share.sum()
        largest = int(share.argmax())
        target = share * (total or spare * have[largest] / share[largest]) / scale
    near = NEARNESS * (found[2 * d:].reshape(d, d) / scale + LEAST_NORM * np.eye(d))

    def states(tried):
        """(objective, gradient, Gram matrix of the rows at no bound) at each of some prices."""
        def sums(p, t):
            out = []
            for x in tried:
                u, rates = p @ x, replay(p, x, cleaning)
                low, high = bounds(p, cleaning)
                free = (1.0 - u >= low) & (1.0 - u <= high)
                used = p[free]
                # The antiderivative of the negative rate in u.
                out.append(np.r_[t @ np.where(free, u * u / 2 - u, -rates * u - (1 - rates) ** 2 / 2),
                                 (t * rates) @ p,
                                 ((used * t[free, None]).T @ used).ravel()])
            return np.concatenate(out)

        for x, v in zip(tried, (_sums(rows, sums) / scale).reshape(len(tried), -1)):
            yield (v[0] + target @ x + x @ near @ x / 2, v[1:1 + d] - target - near @ x,
                   v[1 + d:].reshape(d, d) + near)

    _, gradient, gram = next(states([prices]))
    for _ in range(ITERATIONS):
        if np.abs(gradient).max() < TOLERANCE:
            break
        step = np.linalg.solve(gram, gradient)
        tried = [np.round(prices + x * step, 12) for x in LENGTHS]
        found = list(states(tried))
        best = min(range(len(tried)), key=lambda i: found[i][0])
        prices, (_, gradient, gram) = tried[best], found[best]
    if np.abs(gradient).max() >= TOLERANCE:
        raise RuntimeError(f"no optimal rates after {ITERATIONS} passes: projected gradient "
                           f"{np.abs(gradient).max():.1e} of all tokens")
    missed = gradient + near @ prices
    if np.abs(missed).max() > MISSED * target.sum():
        shares = ", ".join(f"{x} {m:+.1%}" for x, m in zip(DOMAINS, missed / target.sum()))
        warnings.warn(f"targets that no allowed rates meet, of all target tokens: {shares}")
    return prices, missed * scale


def draws(rate: Column, key: Column) -> Column:
    """Whole copies whose expectation is the rate: rounded up with the odds of its fraction."""
    u = F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | str,
        total: float | None = None, spare: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every row, and what the whole misses."""
    rows = stage(posteriors(docs, fit(docs, labels, id_col, text_col), id_col, text_col), "mix-rows")
    prices, missed = solve_rates(rows, weights, total, spare)

    def run(batch, _):
        p = _matrix(batch, "p")
        return {"doc_id": batch.column(0), "n_tokens": batch.column(1),
                **{f"p_{x}": p[:, i] for i, x in enumerate(DOMAINS)}, "rate": replay(p, prices, weights == CLEANING)}

    rated = tuples(rows, run, "doc_id long, n_tokens long, "
                   + ", ".join(f"p_{x} double" for x in DOMAINS) + ", rate double")
    return rated.select("*", draws(F.col("rate"), F.col("doc_id")).alias("copies"),
                        *[F.lit(float(m)).alias(f"missed_{x}") for x, m in zip(DOMAINS, missed)])


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | str,
                    total: float | None = None, spare: float = 1.0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as its rate says; no row moves between machines.

    The rate of a row follows from its text, the classifier and the prices, so the
    texts are scored again where they are read instead of being joined.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = stage(posteriors(docs, model, id_col, text_col).select("tokens", "p"), "mix-rows")
    prices = fit_rates(rows, weights, total, spare)
    shared = docs.sparkSession.sparkContext.broadcast((model, prices))

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        own, found = shared.value
        return pd.Series(replay(own.of_texts(list(texts)), found, weights == CLEANING),
                         dtype="float64")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rated = docs.select(row.alias("row"), rate(utf8(text_col)).alias("rate"))
    copies = draws(F.col("rate"), F.col("row").getField(id_col))
    many = rated.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("one"))
    return many.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
