"""Licence scanning: phrases and identifier tags by Aho-Corasick, tag expressions by shunting-yard."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import carried, sliced, text_of

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases, with labels of their own or a base one.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc",
    "boost software license": "boost", "the unlicense": "unlicense", "creative commons attribution": "cc-by", "cc0": "cc0", "public domain": "public-domain", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit", "licensed under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0", "gnu general public license version 2": "gpl-2.0", "all rights reserved": "reserved",
}
#: How an identifier begins, the family it stands for, and whether its terms are permissive.
FAMILIES = (
    ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("apache", "apache", True), ("mit", "mit", True), ("bsd", "bsd", True), ("isc", "isc", True), ("0bsd", "bsd", True), ("mpl", "mpl", False),
    ("epl", "epl", False), ("cc0", "cc0", True), ("cc-by-nc", "cc-by-nc", False), ("cc-by-nd", "cc-by-nd", False), ("cc-by-sa", "cc-by-sa", False), ("cc-by", "cc-by", True), ("unlicense", "unlicense", True),
    ("zlib", "zlib", True), ("bsl", "boost", True),
)
TAG = " spdx license identifier "
#: Every byte that is no digit, letter or part of a longer character separates words.
SEPARATED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TAG_IN_TEXT = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I | re.A)
#: What ends a comment in which a tag stands.
COMMENT_END = re.compile(r"(?:\*+/|--+>|[\"'#;,])\s*$")
TOKENS = re.compile(r"[()/]|[A-Za-z0-9.+:-]+")
RANK = {"or": 1, "/": 1, "and": 2, "with": 3}


def tokens_of(expression: str) -> list[str]:
    """Brackets, operators and identifiers, these without the signs that end a sentence."""
    found = (t.rstrip(".:-") for t in TOKENS.findall(COMMENT_END.sub("", expression)))
    return [t for t in found if t]


def expression_in(line: str) -> list[str]:
    """The tokens of the expression that a tag's line begins with.

    All of the line if it is well formed; else, where prose or a fault follows, as much as is
    well formed and names known licences only. One look at each token.
    """
    tokens = tokens_of(line)
    depth = whole = known = 0
    operand, all_known = False, True
    for k, token in enumerate(tokens):
        if token.lower() in RANK:
            if not operand:
                break
            operand = False
        elif token == "(":
            if operand:
                break
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif operand:
            break
        else:
            operand = True
            all_known = all_known and (is_known(token) or k > 0 and tokens[k - 1].lower() == "with")
        if operand and not depth:
            whole = k + 1
            known = k + 1 if all_known else known
    return tokens if whole == len(tokens) else tokens[:known]


def to_postfix(expression: str | list[str]) -> list[str]:
    """The tokens of a licence expression in postfix order; ValueError if it is not well formed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False
    for token in tokens_of(expression) if isinstance(expression, str) else expression:
        word = token.lower()
        if word in RANK:
            if not operand:
                raise ValueError("an operator without a left side")
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError("an operator is missing")
            waiting.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("an empty side")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a bracket without its start")
            waiting.pop()
        elif operand:
            raise ValueError("an operator is missing")
        else:
            out.append(token)
            operand = True
    if not operand:
        raise ValueError("an operand is missing")
    while waiting:
        if waiting[-1] == "(":
            raise ValueError("a bracket without its end")
        out.append(waiting.pop())
    return out


def _listed(name: str) -> tuple[str, bool] | None:
    return next(((label, free) for start, label, free in FAMILIES if name == start or name.startswith((start + "-", start + "+"))), None)


def is_known(identifier: str) -> bool:
    return _listed(identifier.lower()) is not None


def family(identifier: str) -> tuple[str, bool]:
    """Label and permissiveness of one identifier; unknown ones keep their name and count as not permissive."""
    name = identifier.lower()
    return _listed(name) or (name, False)


def evaluate(expression: str | list[str]) -> tuple[set[str], bool]:
    """Labels an expression names, and whether it can be met by permissive terms alone (or: either side; and: both; with: its left side)."""
    stack: list[tuple[set[str], bool]] = []
    for token in to_postfix(expression):
        if token.lower() not in RANK:
            label, free = family(token)
            stack.append(({label}, free))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            stack.append((left[0] | right[0], (left[1] and right[1]) if token == "and" else (left[1] or right[1])))
    return stack[0]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES}:
        found.add_word(f" {phrase} ", phrase)
    found.add_word(TAG, TAG)
    found.make_automaton()
    return found


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices, n_tags, permissive."""
    words = text.encode("utf-8", "replace").lower().translate(SEPARATED).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels, notices, tagged = [], set(), set(), 0, False
    words_before = counted_to = 0
    for end, phrase in automaton().iter(line):
        if phrase in BASE:
            # Places come in the order of their ends, so each part of the line is counted once.
            words_before += line.count(" ", counted_to, end)
            counted_to = end
            starts.append(words_before - phrase.count(" ") - 1)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            notices += 1
            labels.add(NOTICES[phrase])
    tags, permissive = 0, None
    if tagged:
        for m in TAG_IN_TEXT.finditer(text):
            expression = expression_in(m[1])
            if not expression:
                continue
            named, free = evaluate(expression)
            tags += 1
            labels |= named
            permissive = free if permissive is None else permissive and free
    labels |= base
    score = 1.0 - 0.5 ** (len(starts) + 0.5 * notices + 2 * tags)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, notices, tags, permissive


ADDED = (
    ("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()),
    ("score", "double", pa.float64()), ("n_notices", "long", pa.int64()), ("n_tags", "long", pa.int64()), ("permissive", "boolean", pa.bool_()),
)


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds to the columns in ``keep`` where licence phrases stand, the labels found and a score.

    Null text counts as empty: no words, no labels, score 0. Of a tag's line that is no
    well-formed expression, the part before the fault counts if it names known licences only.
    Tags that contradict each other are all labelled; permissive is true only if every tag is.
    Rows that repeat are each returned; an empty table gives an empty one. Columns not named in
    ``keep`` are not returned; one in it that is named as an added one is replaced.
    """
    kept = carried(docs, keep, (n for n, _, _ in ADDED))
    width = len(kept.inner)
    inner = docs.select(*kept.inner, text_of(text).alias("_pl_text"))

    def run(batches):
        for batch in sliced(batches):
            rows = [scan_text(t) for t in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(ADDED))], names=[*batch.schema.names[:width], *(n for n, _, _ in ADDED)])

    return kept.named(inner.mapInArrow(run, ", ".join([*kept.schema, *(f"{n} {t}" for n, t, _ in ADDED)])))
