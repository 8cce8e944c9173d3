"""License scan: fuzzy search for short notices, by exact seeds and bounded-error matching.

A notice of n characters with at most k edits, cut into k + 1 pieces, has one piece unchanged (pigeonhole). Each piece is
sought exactly; the stretch around a hit is a candidate, which the ``regex`` library then matches with at most k errors. A
match is reported as a span of whole words with its number of edits.

Texts are lower-cased (A-Z only) and read as words of letters, digits and non-ASCII characters, one space between.

Null and edge cases
* null or empty text: no words, no hits.
* repeated rows are scanned each; an empty table gives an empty result; columns other than id and text are not read.
* exact places of a notice are all reported, overlapping ones too; a fuzzy place is reported only where the notice has no exact
  place, and fuzzy places of one notice do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_batches, plain_words, raw


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int


#: Notice texts and labels (fixed values) with the edits that are still read as the notice; seeds have five characters at least.
BASE = (
    Notice("mit", "mit license", 1),
    Notice("apache", "apache license", 1),
    Notice("gpl", "general public license", 2),
)
NOTICES = (
    *BASE,
    Notice("bsd", "bsd license", 1),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("lgpl", "lesser general public license", 3),
    Notice("agpl", "affero general public license", 3),
    Notice("cc", "creative commons attribution", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("proprietary", "all rights reserved", 2),
)

def _places(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


class Matcher:
    """Seeds and patterns of the notices; ``hits`` scans one normalised text."""

    def __init__(self, notices: tuple[Notice, ...]):
        import regex

        self.notices = []
        for n in notices:
            phrase = n.phrase.encode()
            k = n.edits
            cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
            seeds = [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            pattern = regex.compile(rb"(?e)(?<= )(?:" + regex.escape(phrase) + rb"){e<=" + str(k).encode() + rb"}(?= )") if k else None
            self.notices.append((n, phrase, seeds, pattern))

    def hits(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, first byte, end byte, edits) in a text that begins and ends with a space."""
        out = []
        for i, (n, phrase, seeds, pattern) in enumerate(self.notices):
            k, size = n.edits, len(phrase)
            near: list[tuple[int, int]] = []
            exact: set[int] = set()
            for off, seed in seeds:
                for at in _places(text, seed):
                    first = at - off
                    if first > 0 and text[first - 1 : first + size + 1] == b" " + phrase + b" ":
                        exact.add(first)
                    elif k:
                        near.append((max(first - k - 1, 0), first + size + k + 1))
            out += [(i, a, a + size, 0) for a in sorted(exact)]
            taken = sorted(exact)
            last = 0
            for a, b in _merged(near):
                for m in pattern.finditer(text, a, min(b, len(text))):
                    s, e = m.span()
                    if s >= last and not _overlaps(taken, s, e, size):
                        out.append((i, s, e, sum(m.fuzzy_counts)))
                        last = e
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(starts: list[int], a: int, b: int, size: int) -> bool:
    import bisect

    i = bisect.bisect_left(starts, b)
    return i > 0 and starts[i - 1] + size > a


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words and hits: array of (label, phrase, first_word, words, edits, matched) in text order by notice."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, hits array<struct<label:string,phrase:string,first_word:long,words:int,edits:int,matched:string>>"
    held: list[Matcher] = []

    def scan(cols: dict) -> dict:
        if not held:
            held.append(Matcher(notices))
        counts, hits = [], []
        for data in raw(cols[text]):
            words = plain_words(data)
            line = b" " + b" ".join(words) + b" "
            counts.append(len(words))
            found = held[0].hits(line)
            at, word, first = 0, 0, {}
            for s in sorted({s for _, s, _, _ in found}):
                word += line.count(b" ", at, s)
                at = s
                first[s] = word - 1
            hits.append([
                {"label": notices[i].label, "phrase": notices[i].phrase, "first_word": first[s], "words": line.count(b" ", s, e) + 1,
                 "edits": edits, "matched": line[s:e].decode(errors="replace")}
                for i, s, e, edits in found
            ])
        return {id_col: cols[id_col], "n_words": counts, "hits": hits}

    return map_batches(docs.select(id_col, text), scan, schema)
