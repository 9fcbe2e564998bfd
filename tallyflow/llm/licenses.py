"""License scans: exact phrases, and short notices with spelling errors.

A text is lower-cased (A-Z) and cut into words of letters, digits and all characters beyond ASCII; the words are joined by one space. The
phrases of ``PHRASES`` are counted where they stand word for word. ``NOTICES`` are searched with errors: a notice of which
``k`` letters may be wrong is split into ``k + 1`` pieces, one of which must stand unharmed (pigeonhole). Places of a
piece are found exactly; around each, the regex library's bounded-error matching tells whether the notice is there, with how many errors and
from where to where. Errors are counted in bytes of UTF-8. A notice that stands without an error counts with 0 errors, unless it is itself one of the phrases
(of the same label) and so counted already.

One error turns short notices into other words (``kit license``, ``grant it license``, ``apache licensee``). In notices of fewer than
``SHORT_NOTICE`` letters a match therefore has the notice's words one by one: words of fewer than ``SHORT_WORD`` letters as they are, longer ones with their first and last
letter and neither lengthened nor cut at an end. Words that are usual forms of a notice are notices themselves (``mit licensed``).

``score`` is 1 with an exact phrase, else 1 - errors / length of the best notice (1 for one without errors), else 0. A null or empty text has no words and no labels (empty strings). Very
long texts are scanned whole. Repeated rows each give a row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.texts import map_rows

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices searched with errors, and their labels. Shorter ones would be found in unrelated words.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache",
    "creative commons attribution": "cc-by",
    "mit license": "mit",
    "mit licensed": "mit",
    "apache licensed": "apache",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
}
LETTERS_AN_ERROR = 10  # one error for so many letters of a notice
SHORT_NOTICE = 16  # notices with fewer letters: an error must leave every word recognisable
SHORT_WORD = 5  # words with fewer letters stand unharmed in them

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_CLEAN).split()


class Notice:
    def __init__(self, phrase: str, label: str, letters_an_error: int = LETTERS_AN_ERROR):
        import regex

        self.text, self.label = phrase.encode(), label
        self.errors = len(self.text) // letters_an_error
        size, rest = divmod(len(self.text), self.errors + 1)
        self.pieces, at = [], 0
        for k in range(self.errors + 1):
            n = size + (k < rest)
            self.pieces.append((at, self.text[at : at + n]))
            at += n
        # (?b): the match with the fewest errors; it stands between word borders
        self.pattern = regex.compile(rb"(?b)(?<![^ ])(?:" + regex.escape(self.text, special_only=True) + rb"){e<=%d}(?![^ ])" % self.errors)

    def recognisable(self, found: bytes) -> bool:
        """Does a match of a short notice have its words, with errors inside long words only?"""
        if len(self.text) >= SHORT_NOTICE:
            return True
        meant, read = self.text.split(), found.split()
        return len(meant) == len(read) and all(
            a == b
            or (len(a) >= SHORT_WORD and len(b) >= SHORT_WORD and a[:1] == b[:1] and a[-1:] == b[-1:] and not (a.startswith(b) or b.startswith(a)))
            for a, b in zip(meant, read)
        )

    def find(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, errors) of the places, 0 errors included, in order of discovery."""
        seen, spans = set(), set()
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                start = max(0, at - offset - self.errors)
                if start not in seen:
                    seen.add(start)
                    stop = min(len(text), at - offset + len(self.text) + self.errors)
                    # one byte more on each side shows the search whether a word goes on
                    for m in self.pattern.finditer(text, max(0, start - 1), min(len(text), stop + 1)):
                        if m.span() not in spans and word_borders(text, *m.span()):
                            spans.add(m.span())
                            yield *m.span(), sum(m.fuzzy_counts)
                at = text.find(piece, at + 1)


def word_borders(text: bytes, start: int, stop: int) -> bool:
    return (start == 0 or text[start - 1] == 0x20) and (stop == len(text) or text[stop] == 0x20)


def places(text: bytes, phrase: bytes) -> Iterator[int]:
    at = text.find(phrase)
    while at >= 0:
        if word_borders(text, at, at + len(phrase)):
            yield at
        at = text.find(phrase, at + 1)


def word_numbers(text: bytes, starts: list[int]) -> dict[int, int]:
    """Number of the word that begins at each place, from 0: the text is read once, whatever the number of places."""
    out, before, at = {}, 0, 0
    for start in sorted(set(starts)):
        before += text.count(b" ", at, start)
        out[start], at = before, start
    return out


def scan_documents(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, exact, fuzzy): array<struct<label, first_word, n_words, errors>> of the places, in text order."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def make():
        exact = [(p.encode(), label) for p, label in phrases.items()]
        fuzzy = [Notice(p, label) for p, label in notices.items()]

        def row(doc_id, raw):
            words = license_words(raw)
            text = b" ".join(words)
            here = [(at, label, phrase.count(b" ") + 1, 0) for phrase, label in exact for at in places(text, phrase)]
            around = [
                (a, n.label, text.count(b" ", a, b) + 1, e, len(n.text))
                for n in fuzzy
                for a, b, e in n.find(text)
                if (e or (n.text, n.label) not in exact) and n.recognisable(text[a:b])
            ]
            number = word_numbers(text, [x[0] for x in here + around])
            found, near = (sorted((number[at], *rest) for at, *rest in group) for group in (here, around))
            score = 1.0 if found else max((1 - x[3] / x[4] for x in near), default=0.0)
            spans = [[{"label": x[1], "first_word": x[0], "n_words": x[2], "errors": x[3]} for x in group] for group in (found, near)]
            return ((doc_id, len(words), *spans, score),)

        return row

    span = "array<struct<label:string,first_word:long,n_words:long,errors:int>>"
    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], make,
        f"doc_id long, n_words long, exact {span}, fuzzy {span}, score double",
    )


def label_list(*columns: str):
    """Distinct labels of span arrays, sorted and joined by commas."""
    labels = F.concat(*(F.transform(c, lambda x: x["label"]) for c in columns))
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
