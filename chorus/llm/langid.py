"""Language identification by cross-parsing entropy (operator 9).

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed against it into phrases: each is the longest run of
symbols from the current place that occurs in the sample, found by walking the
automaton, or one unknown symbol. The language whose sample needs the fewest
phrases per symbol wins; equal counts go to the smaller name.

Symbols are lower-case letters; everything between letters is one space. Parsing
starts anew every ``BLOCK`` symbols, so that the blocks of many texts walk the
automaton side by side as numpy columns; one long text is many short blocks and
no task is slowed by it. The ``LETTERS`` most frequent letters of the samples
have symbols of their own; rarer ones are folded by code point into
``FOLDED`` more, which bounds the transition table.

Only the fit is bounded, by documented parameters: ``ROWS`` labelled rows a
language, at most ``CHARS`` characters of each. Every whole text is predicted.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. A missing id is not held out and
not learned from. Repeated rows give equal rows, an empty table an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import tuples

ROWS = 160
CHARS = 400
BLOCK = 256
LETTERS = 90
FOLDED = 32
SYMBOLS_AT_ONCE = 1 << 23
UNKNOWN = "und"

_IS_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def suffix_automaton(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Transition table [state, symbol] of the suffix automaton; 0 means no transition."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(moves) + 1, n_symbols), np.int32)
    for state, row in enumerate(moves):
        for c, to in row.items():
            table[state, c] = to
    return table


class Model:
    """Alphabet and one automaton per language."""

    def __init__(self, samples: dict[str, list[str]]):
        lower = {lang: [t.lower() for t in texts] for lang, texts in samples.items()}
        counts = Counter(c for texts in lower.values() for t in texts for c in t if c.isalpha())
        known = sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS]
        self.symbol_of = {ord(c): i + 1 for i, c in enumerate(known)}
        self.n_known = len(known)
        self.n_symbols = 1 + len(known) + FOLDED + 1  # space, letters, folded ones, end of block
        self.languages, self.tables, self.bits = [], [], []
        for lang in sorted(lower):
            symbols = self.symbols([" ".join(lower[lang])])[0]
            table = suffix_automaton(symbols, self.n_symbols)
            lost = len(table) - 1  # the state after an unknown symbol: whatever follows is new
            root = table[0]
            root[root == 0] = lost
            pad = self.n_symbols - 1
            table[:, pad] = np.arange(len(table))
            self.languages.append(lang)
            self.tables.append(table)
            self.bits.append(float(np.log2(max(2, len(symbols)))))

    def alphabet(self) -> np.ndarray:
        if not hasattr(self, "_alphabet"):
            points = np.arange(0x110000)
            table = np.where(is_letter(), 1 + self.n_known + points % FOLDED, 0).astype(np.uint8)
            for point, symbol in self.symbol_of.items():
                table[point] = symbol
            self._alphabet = table
        return self._alphabet

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_alphabet"}

    def symbols(self, lowered: list[str]) -> list[np.ndarray]:
        """Symbols of each lower-case text: letters, and one space between runs of them."""
        out = []
        for text in lowered:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            s = self.alphabet()[points]
            if len(s):
                s = s[(s != 0) | np.r_[True, s[:-1] != 0]]
            out.append(s)
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text against each language: [text, language]."""
        blocks = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        n = int(blocks.sum())
        if not n:
            return total
        pad = self.n_symbols - 1
        first = np.cumsum(blocks) - blocks
        lanes = np.full((n, BLOCK), pad, np.uint8)
        flat = lanes.ravel()
        for t, at in zip(texts, first):
            flat[at * BLOCK:at * BLOCK + len(t)] = t
        steps = np.ascontiguousarray(lanes.T).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), blocks)
        for k, table in enumerate(self.tables):
            flat_table, root, width = table.ravel(), table[0], np.int32(self.n_symbols)
            state = root.take(steps[0])
            count = np.ones(n, np.int64)
            for c in steps[1:]:
                to = flat_table.take(state * width + c)
                new = to == 0
                count += new
                state = np.where(new, root.take(c), to)
            total[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per symbol and number of symbols of each text."""
        symbols = self.symbols([(t or "").lower() for t in texts])
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rates, sizes = np.full(len(texts), np.nan), np.array([len(s) for s in symbols], np.int64)
        if not self.languages:
            return names, scores, rates, sizes
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(symbols[end]) <= SYMBOLS_AT_ONCE):
                held += len(symbols[end])
                end += 1
            counts = self.phrases(symbols[at:end]) * np.array(self.bits)
            for i in range(at, end):
                if symbols[i].any():
                    row = counts[i - at]
                    best = int(row.argmin())
                    second = np.partition(row, 1)[1] if len(row) > 1 else np.inf
                    names[i] = self.languages[best]
                    scores[i] = 1.0 - row[best] / second
                    rates[i] = row[best] / len(symbols[i])
            at = end
        return names, scores, rates, sizes


def known_language(docs: DataFrame, model: Model, text_col: str = "text",
                   most_bits: float = 5.0, least_symbols: int = 200) -> DataFrame:
    """``docs`` without texts of no language; all columns pass, no row moves.

    A text goes if it is ``und``, or if it has at least ``least_symbols`` symbols and
    even the best language needs more than ``most_bits`` bits for each, what spelling
    it letter by letter would take.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        texts = [t if isinstance(t, str) else None for t in texts]
        names, _, rates, sizes = shared.value.predict(texts)
        odd = (rates > most_bits) & (sizes >= least_symbols)
        return pd.Series(np.array([n != UNKNOWN for n in names], bool) & ~odd)

    return docs.filter(known(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """The test fold: crc32 of the id as text, modulo 5, is 0."""
    fold = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0
    return F.coalesce(fold, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = ROWS, chars: int = CHARS) -> Model:
    """Learn from about ``rows`` rows a language, chosen by a hash of the id.

    Only labelled rows outside the test fold are used. The share of rows taken
    follows from the count of each language, so the sample is bounded at any
    size; the driver receives some ``2 * rows * chars`` characters a language. Of a longer
    text a window of ``chars`` characters is read, at a place chosen by a hash over the
    whole text; equal windows count once.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                           & F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"),
                               (F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30))
                                / float(1 << 30)).alias("u"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    samples: dict[str, list[str]] = {}
    if counts:
        share = F.lit(0.0)
        for lang, n in counts.items():
            share = F.when(F.col("lang") == lang, float(1.5 * rows / n)).otherwise(share)
        places = F.greatest(F.length("t") - chars, F.lit(0)) + 1
        start = F.pmod(F.xxhash64(F.lit("window"), "u"), places) + 1
        chosen = (labelled.filter(F.col("u") < share)
                  .select("lang", "u", F.substring("t", start.cast("int"), chars).alias("t")))
        taken: dict[str, list] = {}
        for r in chosen.toLocalIterator():
            taken.setdefault(r["lang"], []).append((r["u"], r["t"]))
        samples = {lang: list(dict.fromkeys(t for _, t in sorted(x)))[:rows]
                   for lang, x in taken.items()}
    return Model(samples)


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits per symbol of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, _):
        names, scores, rates, _ = shared.value.predict(batch.column(2).to_pylist())
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": names,
                "score": scores, "bits": [None if np.isnan(r) else float(r) for r in rates]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return tuples(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, "
                  "bits double")
