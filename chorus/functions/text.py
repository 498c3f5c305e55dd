"""Text cleaning, tokens and lengths as column expressions."""

from __future__ import annotations

import html.entities
import json
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from chorus.wordlists import CURLY_QUOTES, EMOJI_NAMES, STRAIGHT_QUOTES

# Character classes every result depends on.
MENTION = r"@[\p{L}\p{N}_\-]+"
HTTP_URL = r"https?://[a-z!$-_]+"
WWW_URL = r"www\.[a-z!$-_]+"
# White space; the intersection lets the matcher reject most characters at once.
SPACES = (r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\x{1680}-\x{3000}&&"
          r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]")
PICTOGRAPH = r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}][\x{1f3fb}-\x{1f3ff}]?\x{fe0f}?"
EMOJI = (r"[0-9#*]\x{fe0f}?\x{20e3}|[\x{1f1e6}-\x{1f1ff}]{2}|"
         + PICTOGRAPH + r"(?:\x{200d}" + PICTOGRAPH + r")*")
SIGN_OR_REST = (r"(?s)[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}]\x{fe0f}?|"
                r"[^\x{1f300}-\x{1faff}\x{2600}-\x{27bf}]+")
REPEATED_STOPS = r"([!?.]){2,}"
WORD = r"[\p{L}\p{N}_]{2,}"


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _numbered(digits: Column, base: int) -> Column:
    """The character of a numeric reference, as browsers read it."""
    bare = F.regexp_replace(digits, "^0+", "")
    most = F.length(bare) <= (7 if base == 10 else 6)
    n = F.when(most, F.conv(F.concat(F.lit("0"), bare), base, 10).cast("long")).otherwise(1 << 30)
    special = F.from_json(F.lit(json.dumps({str(n): c for n, c in _SPECIAL.items()})),
                          "map<string,string>")
    code = F.unhex(F.lpad(F.hex(n), 8, "0"))
    return (F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .otherwise(F.coalesce(F.try_element_at(special, n.cast("string")),
                                  F.when(_invalid(n), F.lit("")).otherwise(F.decode(code, "UTF-32")))))


# What the HTML standard makes of numbers that are no character of their own.
_SPECIAL = {0x00: "\ufffd", 0x0D: "\r", **{
    n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}}


def _invalid(n: Column) -> Column:
    """Control characters and noncharacters, which leave nothing."""
    return (n.between(0x1, 0x8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | (n == 0xB)
            | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal HTML references to characters.

    A name without a semicolon counts where the standard allows it; of an unknown
    name the longest such beginning is taken, else it stays. Only texts with an
    ampersand are cut into references and the text between them.
    """
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    short = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    start = f"^({'|'.join(short)})"

    def one(x: Column) -> Column:
        body = F.substring(x, 2, 100)
        begin = F.regexp_extract(body, start, 1)
        named = F.coalesce(
            F.try_element_at(names, body),
            F.when(begin != "", F.concat(F.try_element_at(names, begin),
                                         F.substr(body, F.length(begin) + 1))), x)
        hexed = F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+);?$", 1)
        decimal = F.regexp_extract(x, "^&#([0-9]+);?$", 1)
        return (F.when(~F.startswith(x, F.lit("&")) | (x == "&"), x)
                .when(hexed != "", _numbered(hexed, 16))
                .when(decimal != "", _numbered(decimal, 10)).otherwise(named))

    parts = F.regexp_extract_all(text, F.lit(f"(?s){_REFERENCE}|[^&]+|&"), F.lit(0))
    decoded = F.array_join(F.transform(parts, one), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def remove_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def has_emoji(text: Column) -> Column:
    return F.rlike(text, F.lit(EMOJI))


def name_emoji(text: Column, names: dict[str, str] = EMOJI_NAMES) -> Column:
    """Replace each known emoji with its ``:name:``; unknown ones stay.

    A variation selector after a sign goes with it. The names are one constant map.
    """
    known = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    parts = F.regexp_extract_all(text, F.lit(SIGN_OR_REST), F.lit(0))
    named = F.array_join(F.transform(parts, lambda x: F.coalesce(
        F.try_element_at(known, F.replace(x, F.lit("\ufe0f"), F.lit(""))), x)), "")
    return F.when(has_emoji(text), named).otherwise(text)


def remove_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, "")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, HTTP_URL, ""), WWW_URL, "")


def normalize_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def straighten_quotes(text: Column) -> Column:
    return F.translate(text, CURLY_QUOTES, STRAIGHT_QUOTES)


def collapse_stops(text: Column) -> Column:
    """A run of sentence marks becomes the last mark of the run."""
    return F.regexp_replace(text, REPEATED_STOPS, "$1")


def cleaning_steps(text: Column, quotes: bool = False) -> "OrderedDict[str, Column]":
    """The text after each step, in the fixed order of the steps."""
    steps: OrderedDict[str, Column] = OrderedDict()
    steps["entities"] = decode_entities(F.coalesce(text, F.lit("")))
    steps["emoji"] = remove_emoji(steps["entities"])
    steps["mentions"] = remove_mentions(steps["emoji"])
    steps["urls"] = remove_urls(steps["mentions"])
    steps["spaces"] = normalize_spaces(steps["urls"])
    if quotes:
        steps["quotes"] = straighten_quotes(steps["spaces"])
    steps["stops"] = collapse_stops(next(reversed(steps.values())))
    return steps


def clean_text(text: Column, quotes: bool = False) -> Column:
    """The whole cleaning chain; missing text becomes the empty string."""
    return cleaning_steps(text, quotes)["stops"]


def reduction_percent(before: Column, after: Column) -> Column:
    """Share of characters removed, in percent with two digits."""
    return F.round(F.try_divide(before - after, before) * 100, 2)


def word_count(text: Column) -> Column:
    """Number of words between white space; blank text has none."""
    spaced = normalize_spaces(text)
    gaps = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return (gaps + (spaced != "").cast("int")).cast("bigint")


def tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without(words: Column, stop_words: Sequence[str]) -> Column:
    """Drop stop words and keep the order and repeats of the rest."""
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def ngrams(words: Column, shortest: int = 1, longest: int = 3) -> Column:
    """All runs of ``shortest`` to ``longest`` words joined by one space."""
    def of_length(k: int) -> Column:
        grams = words
        for place in range(2, k + 1):
            shifted = F.slice(words, place, F.greatest(F.size(words), F.lit(1)))
            grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(grams, lambda g: g.isNotNull()) if k > 1 else grams

    return F.concat(*[of_length(k) for k in range(shortest, longest + 1)])


def pad_sequence(ids: Column, length: int) -> Column:
    """Cut or pad an id array with zeros to exactly ``length``."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(0), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column, length: int) -> Column:
    """Ones for the kept ids, zeros for the padding."""
    kept = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))
