from __future__ import annotations

import re

from chorus.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


TEXTS = ["This work is licensed under the GNU General Public License, version 3.",
         "Licensed under CC BY-NC 4.0. cc by cc by", "Released under the MIT License. mit-license",
         "Licensed under the Apache License, Version 2.0.", "the mit licence", "é MIT license é"]


def test_base_places_like_brute_force(frame, awkward, clashing):
    texts = awkward + TEXTS
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in licences.licence_scan(clashing(frame(texts))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_labels_keep_the_base_ones_and_scores_are_shares(frame):
    rows = licences.licence_scan(frame(TEXTS)).collect()
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "gpl-notice" in rows[0].labels and rows[0].score == 1.0


def test_optional_and_replaceable_regions():
    automaton = licences.Automaton("a <<optional>>b c<</optional>> d <<var 1 2>> e")
    ends = {t: automaton.longest(t.encode().split(), 0) for t in
            ("a d x e", "a b c d x e", "a d x y e", "a d e", "a b d x e", "a d x y z e", "a b c d x e e")}
    assert ends == {"a d x e": 4, "a b c d x e": 6, "a d x y e": 5, "a d e": -1, "a b d x e": -1,
                    "a d x y z e": -1, "a b c d x e e": 7}


def test_mandatory_wording_must_match_exactly(frame):
    got = licences.licence_scan(frame(["licensed under the gnu general private license",
                                       "released beneath the mit license"])).collect()
    assert [r.labels for r in got] == ["", "mit"]


def test_empty_table(frame):
    assert licences.licence_scan(frame([])).count() == 0
