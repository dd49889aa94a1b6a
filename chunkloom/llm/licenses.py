"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser reads the
and/or/with expressions behind the tags.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; phrases match whole words wherever
they stand consecutively. Null and empty texts have no words and no licences (score 0, empty labels). Repeated rows give
repeated results; any further columns are ignored. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.shared import rowwise
from chunkloom.llm.words import FOLD, encoded

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices with labels of their own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: A tag's words; the expression stands behind it in the raw line.
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+_:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}
# fixed values: short identifiers without a version, and names in common use
PLAIN = frozenset("""
0bsd aal agpl apache bsd bsl bzip2 cc0 curl cc-by cc-by-nc cc-by-nd cc-by-sa epl fsfap fsful ftl gpl icu ijg isc json lgpl libpng libtiff mit mit-0 mpl
ncsa ngpl ntp openssl php postgresql public-domain python ruby sendmail sleepycat sqlite tcl unlicense vim w3c wtfpl x11 xnet zlib zpl
""".split())
_VERSIONED = re.compile(r"(?=.*\d)[a-z0-9]+(?:\.[a-z0-9]+)*(?:-[a-z0-9]+(?:\.[a-z0-9]+)*)+")
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
PERMISSIVE = frozenset("mit apache apache-2.0 bsd bsd-2-clause bsd-3-clause isc 0bsd cc0 cc0-1.0 cc-by cc-by-4.0 cc-by-3.0 unlicense bsl bsl-1.0 zlib public-domain".split())


def is_identifier(t: str) -> bool:
    """Whether a lower-cased token has the form of a licence or exception identifier: a name with a version, one of ``PLAIN``, a reference or an exception."""
    t = t.removesuffix("+")
    return t in PLAIN or bool(_VERSIONED.fullmatch(t) or _OWN.fullmatch(t)) or t.endswith("-exception")


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of a licence expression, by the shunting-yard algorithm: ``with`` binds before ``and`` before ``or``.

    Reads the longest valid prefix of ``text`` and returns None if there is none, so prose behind an expression, or instead of one, is harmless;
    so are NONE and NOASSERTION, which name no licence.
    """
    tokens, depth, good, want = [], 0, 0, True
    for m in _TOKEN.finditer(text):
        t = m[0].rstrip(".:") if m[0] not in "()" else m[0]
        low = t.lower()
        if want and t == "(":
            depth += 1
        elif want and is_identifier(low):
            want = False
        elif not want and t == ")" and depth:
            depth -= 1
        elif not want and low in _RANK:
            want = True
        else:
            break
        tokens.append(low)
        if not want and depth == 0:
            good = len(tokens)
    if not good:
        return None
    out, ops = [], []
    for t in tokens[:good]:
        if t == "(":
            ops.append(t)
        elif t == ")":
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif t in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
        else:
            out.append(t)
    return out + ops[::-1]


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the expression can be met with ``allowed`` licences only; an exception (``with``) counts as its licence does."""
    stack: list[bool] = []
    for t in rpn:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a and b if t == "and" else a or b)
        else:
            stack.append(t.removesuffix("+") in allowed)
    return stack[0]


def licence_ids(rpn: list[str]) -> set[str]:
    """The licences an expression names, without exceptions."""
    stack: list[set[str]] = []
    for t in rpn:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a | b)
        else:
            stack.append({t})
    return stack[0]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, "base", label))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, "notice", label))
    found.add_word(f" {TAG} ", (len(TAG) + 1, "tag", ""))
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive) of one text."""
    words = encoded(text).translate(FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    n_base, first, last, base, labels, miss, tagged = 0, None, None, set(), set(), 1.0, False
    seen = at = 0
    for end, (length, kind, label) in automaton().iter(line):
        miss *= 0.3
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        if kind == "base":
            base.add(label)
            n_base += 1
            start = end - length
            # matches end in order, but a longer phrase may begin before the last start seen
            seen += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            first, last = seen if first is None else min(first, seen), seen if last is None else max(last, seen)
    said, permissive = [], None
    if tagged:
        for m in _TAG_LINE.finditer(text):
            if rpn := parse_expression(m[1]):
                labels |= licence_ids(rpn)
                said.append(" ".join(rpn))
                permissive = evaluate(rpn) and permissive is not False
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - miss, 6), "; ".join(said), permissive


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permissive", pa.bool_())])
SQL_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def _work(columns: list[list]) -> list[list]:
    ids, texts = columns
    rows = [scan(t) for t in texts]
    return [ids, *map(list, zip(*rows, strict=True))]


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): see the module's text."""
    return rowwise(docs, ["doc_id", "text"], SCHEMA, _work, SQL_SCHEMA)
