"""Line de-duplication by a deletion-neighbourhood join (operator 7).

Lines are compared as sequences of words, so white space inside a line does not
matter. The edit bound is one word deleted, inserted or replaced, for lines of at
least ``LEAST_WORDS`` words (a similarity of 0.8 or more); shorter lines must have
equal words. Order is that of the id, then of the line in its text. A line goes
if an earlier line lies within the bound; blank lines stay where they are.

Only DataFrame functions are used:

1. equal lines collapse to their first occurrence; hashes and places move, no text;
2. one edit leaves the first or the last half of the words as it was. Lines that
   share no such half with another line can have no partner and emit nothing;
   Halves of a single line are sieved out before any line moves, by a bitmap of
   fixed size;
3. the others emit their variants, every one-word deletion as a hashed key with
   the place of the deletion, and themselves. Equal keys and places are lines one
   replacement apart, a variant that equals a line is one deletion apart from it.
   Each key is reduced to its earliest line, never to pairs;
4. each match is verified on the words of both lines.

Keys are aggregated before they are joined and the joins are ordinary ones that
adaptive execution can split, so a line that occurs in a third of all rows costs
one row per task.

Defined results: a null text stays null and an empty one empty; a missing id
comes last; rows with equal id and text are one document, so that both keep the
same lines; an empty table gives an empty result. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chorus.llm.common import marked, maybe, order_id, stage

LEAST_WORDS = 5
_BLANKS = "[ \\t\\x0B\\f\\r]+"


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, _BLANKS), "")


def _without(words: Column, at: Column) -> Column:
    """The words but the one at place ``at`` (from 0)."""
    return F.concat(F.slice(words, F.lit(1), at),
                    F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0))))


def _keys(words: Column) -> Column:
    """The key of a line and those of its variants with one word less, in order of the place.

    A key is the exclusive or of a hash per word and place, so that the next variant differs
    by two of them; no words are hashed again for each variant.
    """
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    ahead = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))  # a word after the one left out
    steps = F.zip_with(F.slice(here, F.lit(1), F.size(here) - 1),
                       F.slice(ahead, F.lit(2), F.size(ahead) - 1), lambda a, b: a.bitwiseXOR(b))
    every = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    variants = F.aggregate(
        steps, F.array(every(F.slice(ahead, F.lit(2), F.size(ahead) - 1))),
        lambda made, step: F.concat(made, F.array(F.element_at(made, -1).bitwiseXOR(step))))
    return F.concat(F.array(every(here)), variants)


def _half_keys(words: Column, n: Column) -> Column:
    """Keys of the halves that one edit leaves alone, for a partner as long or one word longer."""
    keys = []
    for shorter in (n, n - 1):
        half = F.greatest(F.floor(shorter / 2).cast("int"), F.lit(0))
        keys += [F.xxhash64(F.lit("head"), shorter, F.slice(words, F.lit(1), half)),
                 F.xxhash64(F.lit("tail"), shorter, F.slice(words, n - half + 1, half))]
    return F.array(*keys)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line: its place (doc, version, line) and hashes of its words."""
    lines = (docs.filter(F.col(text_col).isNotNull())
             .select(order_id(id_col).alias("doc"), F.xxhash64(text_col).alias("version"),
                     F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "raw")))
    words = lines.select("doc", "version", "line", _words(F.col("raw")).alias("words"))
    n = F.size("words")
    return words.select(
        "doc", "version", "line", n.alias("n"), F.xxhash64("words").alias("h"),
        F.xxhash64(F.lit("second"), F.col("words")).alias("h2"),
        F.when(n >= LEAST_WORDS, _half_keys(F.col("words"), n)).alias("halves"))


def _with_lines(text: Column, use) -> Column:
    """``use`` of the lines of a text, which are cut once and not per element that is used."""
    return F.transform(F.array(F.split(text, "\n", -1)), use)[0]


def _document() -> Column:
    return F.xxhash64("doc", "version")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(order_id(id_col).alias("doc"), F.xxhash64(text_col).alias("version"),
                       F.col(text_col).alias("t")).filter(F.col("t").isNotNull())


def _candidates(first: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, h2, first, words, keys) of the lines that share a half with another line, staged.

    ``keys`` are the hash of the line and those of its variants, one word less each.
    """
    long = first.filter(F.col("n") >= LEAST_WORDS)
    halves = long.select("h", "h2", F.explode("halves").alias("half"))
    shared = stage(halves.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1")
                   .select("half"), "line-halves")
    chosen = (maybe(halves, F.col("half"), shared).join(shared, "half", "left_semi")
              .select("h", "h2").distinct().join(long.select("h", "h2", "first"), ["h", "h2"]))
    per_doc = stage(
        chosen.groupBy(F.col("first.doc").alias("doc"), F.col("first.version").alias("version"))
        .agg(F.collect_list(F.col("first.line")).alias("at")), "line-wanted")
    texts = maybe(_texts(docs, id_col, text_col), _document(), per_doc.select(_document().alias("k")))
    chosen_lines = _with_lines(F.col("t"), lambda lines: F.transform(
        "at", lambda i: F.struct(i.alias("line"), F.element_at(lines, i + 1).alias("raw"))))
    found = (texts.join(per_doc, ["doc", "version"])
             .select("doc", "version", F.explode(chosen_lines).alias("x"))
             .select(F.struct("doc", "version", "x.line").alias("first"),
                     _words(F.col("x.raw")).alias("words"))
             .select("first", "words", F.xxhash64("words").alias("h"),
                     F.xxhash64(F.lit("second"), F.col("words")).alias("h2")))
    # Rows with equal id and text are one document.
    lines = found.groupBy("h", "h2").agg(F.min("first").alias("first"), F.first("words").alias("words"))
    return stage(lines.withColumn("keys", _keys(F.col("words"))), "line-candidates")


def _near(lines: DataFrame) -> DataFrame:
    """(h, h2) of the candidates with an earlier line one word apart, verified."""
    every = (lines.select("h", "h2", "first", F.posexplode("keys").alias("at", "key"))
             .select("h", "h2", "first", (F.col("at") - 1).alias("at"), "key"))  # -1: the line itself
    twice = stage(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"),
                  "line-keys")
    emitted = stage(maybe(every, F.col("key"), twice), "line-variants")

    line = F.struct("first", "h", "h2", "at")
    least = stage(emitted.groupBy("key", "at").agg(F.min(line).alias("least"), F.count("*").alias("n")),
                  "line-least")
    replaced = (emitted.filter("at >= 0").join(least.filter("n > 1 and at >= 0"), ["key", "at"])
                .select("h", "h2", "first", "at", "least"))
    whole = least.filter("at < 0").select("key", F.col("least").alias("whole"))
    deleted = (least.filter("at >= 0").groupBy("key").agg(F.min("least").alias("least"))
               .join(whole, "key"))
    longer = (emitted.filter("at >= 0").join(whole, "key")
              .select("h", "h2", "first", "at", F.col("whole").alias("least")))
    shorter = deleted.select("whole.h", "whole.h2", "whole.first", "whole.at", "least")
    matches = (replaced.unionByName(longer).unionByName(shorter)
               .filter(F.col("least.first") < F.col("first"))
               .select("h", "h2", "at", F.col("least.h").alias("e"), F.col("least.h2").alias("e2"),
                       F.col("least.at").alias("e_at")).distinct())
    words = lines.select("h", "h2", "words")
    left = F.when(F.col("at") < 0, F.col("words")).otherwise(_without(F.col("words"), F.col("at")))
    right = F.when(F.col("e_at") < 0, F.col("e_words")).otherwise(
        _without(F.col("e_words"), F.col("e_at")))
    return (matches.join(words, ["h", "h2"])
            .join(words.select(F.col("h").alias("e"), F.col("h2").alias("e2"),
                               F.col("words").alias("e_words")), ["e", "e2"])
            .filter((left == right) & (F.size("words") >= LEAST_WORDS)
                    & (F.size("e_words") >= LEAST_WORDS))
            .select("h", "h2").distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the lines that stay; ``counts`` names columns for lines seen and dropped."""
    places = stage(_occurrences(docs, id_col, text_col), "line-places")
    first = stage(places.filter("n > 0").groupBy("h", "h2", "n", "halves")
                  .agg(F.min(F.struct("doc", "version", "line")).alias("first")), "line-first")
    near = _near(_candidates(first, docs, id_col, text_col))
    stay = (first.select("h", "h2", "first").join(near, ["h", "h2"], "left_anti").select("first.*")
            .unionByName(places.filter("n = 0").select("doc", "version", "line")))
    kept = stay.groupBy("doc", "version").agg(F.collect_set("line").alias("kept"))
    lines = places.groupBy("doc", "version").agg(F.max("line").alias("last"))
    # Documents that lose no line need not move.
    changed = stage(lines.join(kept, ["doc", "version"], "left")
                    .withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
                    .filter(F.size("kept") <= F.col("last"))
                    .select("doc", "version", F.array_sort("kept").alias("kept")), "line-changed")

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      order_id(id_col).alias("doc"), F.xxhash64(text_col).alias("version"))
    looked = marked(row, _document(), changed.select(_document().alias("k")))
    met = (looked.filter("_maybe").join(changed, ["doc", "version"], "left").select("row", "kept")
           .unionByName(looked.filter(~F.col("_maybe")).select(
               "row", F.lit(None).cast("array<int>").alias("kept"))))
    text = F.col("row").getField(text_col)
    left = F.when(F.col("kept").isNull() | text.isNull(), text).otherwise(
        _with_lines(text, lambda lines: F.array_join(
            F.transform("kept", lambda at: F.element_at(lines, at + 1)), "\n")))
    out = [left.alias(c) if c == text_col else F.col("row").getField(c).alias(c)
           for c in docs.columns]
    if counts:
        ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        seen = F.when(text.isNull(), 0).otherwise(ends + 1).cast("long")
        gone = F.when(F.col("kept").isNull() | text.isNull(), 0).otherwise(seen - F.size("kept"))
        out += [seen.alias(counts[0]), gone.cast("long").alias(counts[1])]
    return met.select(*out)
