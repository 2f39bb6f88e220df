"""Licences that a text names: notice phrases, identifier tags and the expressions behind the tags.

One Aho-Corasick automaton finds notice phrases and the tag; the expression behind a tag (identifiers joined by
AND, OR and WITH, with brackets) is put in order by a shunting-yard parser and evaluated to labels and a score.
AND needs both sides (the lower score), OR offers either (the higher score), WITH adds an exception to a licence.
An expression that cannot be parsed gives the identifiers that are known, at half their score.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from offerloom.llm.common import id_and_text, ship
from offerloom.llm.phrases import Phrases, char_spans, words_of

ship(__name__)

#: Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases: label and score.
NOTICES = {
    "licensed under the mit license": ("mit", 1.0),
    "released under the mit license": ("mit", 1.0),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "licensed under the apache license version 2 0": ("apache-2.0", 1.0),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 1.0),
    "gnu general public license version 3": ("gpl-3.0", 1.0),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "isc license": ("isc", 0.8),
    "cc by 4 0": ("cc-by-4.0", 0.9),
    "cc by sa 4 0": ("cc-by-sa-4.0", 0.9),
    "cc by nc 4 0": ("cc-by-nc-4.0", 0.9),
    "cc by nd 4 0": ("cc-by-nd-4.0", 0.9),
    "cc by nc sa 4 0": ("cc-by-nc-sa-4.0", 0.9),
    "cc by nc nd 4 0": ("cc-by-nc-nd-4.0", 0.9),
    "cc0 1 0": ("cc0-1.0", 0.9),
    "creative commons attribution": ("cc-by", 0.7),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_SCORE = 0.8
#: Words of the tag in front of an expression.
TAG = "spdx license identifier"
#: Identifiers that a tag may name, in lower case; others score UNKNOWN_SCORE.
KNOWN = frozenset(
    "mit apache-2.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later mpl-2.0 epl-2.0 "
    "bsd-2-clause bsd-3-clause isc unlicense cc0-1.0 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 zlib wtfpl bsl-1.0".split()
)
UNKNOWN_SCORE = 0.5
#: Binding strength of the operators.
STRENGTH = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
LABELLED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, notices array<struct<label:string,start:long,end:long>>"
)


def expression_tokens(text: str) -> list[str]:
    """Tokens of the expression a text begins with; it ends at the line's end or at something else."""
    out, at, open_brackets, operand = [], 0, 0, True
    line = re.split(r"[\n\r]", text, maxsplit=1)[0]
    while m := TOKEN.match(line, at):
        token = m[1].lower()
        if token == "(":
            if not operand:
                break
            open_brackets += 1
        elif token == ")":
            if operand or not open_brackets:
                break
            open_brackets -= 1
        elif operand:
            token, operand = token.rstrip(".:-"), False
        elif token in STRENGTH:
            operand = True
        else:
            break
        out.append(token)
        at = m.end()
    return out


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators behind their operands.  ValueError if brackets or operands do not fit."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or operand:
                raise ValueError("bracket")
            held.pop()
        elif token in STRENGTH and not operand:
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            out.append(token)
            operand = False
    if operand or "(" in held:
        raise ValueError("operand or bracket")
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels and score of an expression."""

    def score(name: str) -> float:
        return 1.0 if name in KNOWN else UNKNOWN_SCORE

    try:
        stack: list[tuple[set[str], float]] = []
        for token in to_postfix(tokens):
            if token not in STRENGTH:
                stack.append(({token}, score(token)))
                continue
            (right, r), (left, s) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{a} with {b}" for a in left for b in right}, s))
            else:
                stack.append((left | right, max(s, r) if token == "or" else min(s, r)))
        return stack[0]
    except (ValueError, IndexError):
        known = {t for t in tokens if t in KNOWN}
        return known, 0.5 if known else 0.0


class Scanner:
    """Phrases, their meaning, and the scan of one text."""

    def __init__(self):
        names = list(dict.fromkeys([*BASE, *NOTICES, TAG]))
        self.names = names
        self.phrases = Phrases([n.encode().split() for n in names])

    def scan(self, doc_id: int | None, text: str) -> tuple:
        words = words_of(text)
        starts, base, labels, score, notices, chars = [], set(), set(), 0.0, [], None
        for number, first in self.phrases.find(words):
            name = self.names[number]
            if chars is None:
                chars = char_spans(text)
            begin, end = chars[first][0], chars[first + len(self.phrases.phrases[number]) - 1][1]
            if name in BASE:
                starts.append(first)
                base.add(BASE[name])
                found, value = {BASE[name]}, BASE_SCORE
            elif name in NOTICES:
                found, value = {NOTICES[name][0]}, NOTICES[name][1]
            else:
                found, value = evaluate(expression_tokens(text[end:].lstrip(": \t")))
            labels |= found
            score = max(score, value)
            notices += [{"label": label, "start": begin, "end": end} for label in sorted(found)]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        base_labels, all_labels = ",".join(sorted(base)), ",".join(sorted(labels | base))
        return doc_id, len(words), len(starts), first, last, base_labels, all_labels, score, notices


def _mapper(scanner):
    long, text = pa.int64(), pa.string()
    notice = pa.list_(pa.struct([("label", text), ("start", long), ("end", long)]))
    types = [long, long, long, long, long, text, text, pa.float64(), notice]
    names = [p.split()[0] for p in LABELLED.split(", ")]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.value.scan(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return scan


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts and labels, all labels, score, and notices with character places."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner())
    return id_and_text(docs, doc_id, text).mapInArrow(_mapper(scanner), LABELLED)
