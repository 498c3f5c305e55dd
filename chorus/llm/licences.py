"""Licence scans by template-markup matching (operator 8).

A template is licence wording with markup: ``<<optional>> ... <</optional>>``
may be absent, ``<<var 1 4>>`` stands for one to four words of any kind. A
template compiles into an automaton over words; a text is accepted where its
words follow the automaton from the first mandatory word to the last one, so
the mandatory wording must match exactly. The automata run only from places
whose word starts a template.

Base places of the four phrases are found besides. Defined results: a null text
is empty; an empty text has no words, null places, empty labels and score 0;
repeated rows give equal rows; an empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import tuples, utf8

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

TEMPLATES = {
    "gpl-notice": "<<optional>>this work is<</optional>> licensed under the "
                  "<<optional>>terms of the<</optional>> gnu general public license "
                  "<<optional>>as published by the free software foundation<</optional>> "
                  "<<optional>>version <<var 1 2>><</optional>>",
    "apache-notice": "licensed under the apache license <<optional>>version 2 0<</optional>>",
    "cc-by-notice": "<<optional>>this work is<</optional>> licensed under "
                    "<<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by "
                    "<<optional>>nc<</optional>> <<optional>>sa<</optional>> "
                    "<<optional>>nd<</optional>> <<optional>>4 0<</optional>>",
    "mit-notice": "<<optional>>released<</optional>> under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of "
                "this software and associated documentation files the software to deal in the "
                "software without restriction",
    "bsd-text": "redistribution and use in source and binary forms with or without modification "
                "are permitted provided that the following conditions are met",
    "copyright-notice": "copyright <<optional>>c<</optional>> <<var 1 1>> <<var 1 4>> "
                        "all rights reserved",
}

#: Word bytes of the contract after lower-casing A-Z; every other byte becomes a space.
_WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90
    or 97 <= b <= 122 else 32 for b in range(256))
_MARK = re.compile(r"<<(/?optional|var \d+ \d+)>>|(\S+?)(?=\s|<<|$)")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """A template as states with word moves, free moves and any-word moves."""

    def __init__(self, template: str):
        self.moves: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        at, opened = 0, []
        for mark, word in _MARK.findall(template):
            if mark == "optional":
                opened.append(at)
            elif mark == "/optional":
                self.free[opened.pop()].append(at)
            elif mark:
                least, most = map(int, mark.split()[1:])
                skips = []
                for i in range(most):
                    if i >= least:
                        skips.append(at)
                    at = self._step(at, None)
                for s in skips:
                    self.free[s].append(at)
            else:
                at = self._step(at, word.encode())
        self.last = at
        self.start = self._closure({0})
        self.first_words = {w for s in self.start for w in self.moves[s]}

    def _step(self, at: int, word: bytes | None) -> int:
        self.moves.append({})
        self.any.append(None)
        self.free.append([])
        to = len(self.moves) - 1
        if word is None:
            self.any[at] = to
        else:
            self.moves[at][word] = to
        return to

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words that starts at ``at``, or -1."""
        states, best = self.start, -1
        while states:
            if self.last in states:
                best = at
            if at == len(words):
                break
            w, following = words[at], set()
            for s in states:
                if w in self.moves[s]:
                    following.add(self.moves[s][w])
                if self.any[s] is not None:
                    following.add(self.any[s])
            states, at = self._closure(following), at + 1
        return best


def scanner(phrases: dict[str, str], templates: dict[str, str]):
    """A function of the words of a text to places, labels and covered words."""
    lists = [(p.encode().split(), label) for p, label in phrases.items()]
    by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, template in templates.items():
        automaton = Automaton(template)
        for w in automaton.first_words:
            by_first.setdefault(w, []).append((label, automaton))
    phrase_first: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for p in lists:
        phrase_first.setdefault(p[0][0], []).append(p)
    starters = set(by_first) | set(phrase_first)

    def scan(words: list[bytes]):
        places, base, more, spans = [], set(), set(), []
        if not starters.isdisjoint(words):
            for i, w in enumerate(words):
                if w not in starters:
                    continue
                for p, label in phrase_first.get(w, ()):
                    if words[i:i + len(p)] == p:
                        places.append(i)
                        base.add(label)
                        spans.append((i, i + len(p)))
                for label, automaton in by_first.get(w, ()):
                    end = automaton.longest(words, i)
                    if end > i:
                        more.add(label)
                        spans.append((i, end))
        covered, reach = 0, 0
        for a, b in sorted(spans):
            covered += max(0, b - max(a, reach))
            reach = max(reach, b)
        return places, base, base | more, covered

    return scan


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: dict[str, str] = PHRASES,
                 templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Phrase places and template labels of every whole text.

    ``score`` is the share of the words that lie in a phrase or an accepted template.
    """
    def run(batch, scan):
        out: dict[str, list] = {k: [] for k in (
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
            "score")}
        for text in batch.column(1).to_pylist():
            words = words_of(text or b"")
            places, base, labels, covered = scan(words)
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min(places, default=None))
            out["last_word"].append(max(places, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(labels)))
            out["score"].append(covered / len(words) if words else 0.0)
        out["doc_id"] = batch.column(0)
        out["score"] = np.array(out["score"], dtype=np.float64)
        return out

    return tuples(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")),
                  run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                  "base_labels string, labels string, score double",
                  lambda: scanner(phrases, templates))
