"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates the tags' expressions.

A text becomes a stream of words in lower case, each between single spaces, and one pass of the automaton over it finds every
phrase. Documents with a tag are read again at the tag to get its expression, with brackets.
Every document is handled alone, so there is no shuffle.

Defined cases. Null or empty text: no words, no places, empty labels, score 0. Null doc_id and repeated rows: a result row each.
Tags without a valid expression count as no expression. Empty table: no rows. Other columns don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Phrases of the base scan and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, with labels of their own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Identifiers whose licences ask for no more than notices; the policy that expressions are evaluated under unless another is given.
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib")
#: How much each kind of evidence says that the text carries a licence.
WEIGHTS = {"tag": 0.95, "base": 0.8, "notice": 0.5}

WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: Operators by how tightly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def to_postfix(expression: str) -> list[str] | None:
    """Shunting yard: the longest valid expression that the text begins with, in postfix order, in lower case; None if there is none."""
    tokens: list[str] = []
    depth, operand, valid, at = 0, True, 0, 0  # open brackets, whether an operand has to come next, tokens of the longest valid prefix, place
    while m := TOKEN.match(expression, at):
        t, at = m[1].lower(), m.end()
        if (t in BINDS or t == ")") == operand or t == ")" and not depth:  # it can't follow, so no longer prefix is valid
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        operand = t == "(" or t in BINDS
        if not operand and not depth:
            valid = len(tokens)
    out: list[str] = []
    held: list[str] = []
    for t in tokens[:valid]:
        if t == "(":
            held.append(t)
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif t in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
        else:
            out.append(t)
    return out + held[::-1] if valid else None


def evaluate(postfix: list[str], allowed: Callable[[str], bool]) -> bool:
    """The expression under a policy: or needs one side, and needs both; with an exception a licence is as allowed as without."""
    stack: list = []
    for t in postfix:
        if t in BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left if t == "with" else value(left, allowed) or value(right, allowed) if t == "or" else value(left, allowed) and value(right, allowed))
        else:
            stack.append(t)
    return value(stack.pop(), allowed)


def value(x: str | bool, allowed: Callable[[str], bool]) -> bool:
    return allowed(x) if isinstance(x, str) else x


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, find: ahocorasick.Automaton, allowed: Callable[[str], bool]) -> tuple:
    """The result columns but doc_id."""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    stream = f" {b' '.join(words).decode('latin-1')} "
    first = last = None
    n_base, base, labels, doubt, expressions = 0, set(), set(), 1.0, []
    counted, at, read = 0, 0, False
    for end, phrase in sorted(find.iter(stream), key=lambda x: x[0] - len(x[1])):
        start = end - len(phrase) - 1  # of the space before it
        counted += stream.count(" ", at, start)
        at = start
        if phrase in BASE_PHRASES:
            n_base += 1
            base.add(BASE_PHRASES[phrase])
            first, last = counted if first is None else first, counted
            doubt *= 1 - WEIGHTS["base"]
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            doubt *= 1 - WEIGHTS["notice"]
        if phrase == TAG and not read:
            read = True  # all tags at once
            expressions = [p for line in TAG_LINE.findall(text) if (p := to_postfix(line))]
            for p in expressions:
                labels.update(x for x in p if x not in BINDS)
                doubt *= 1 - WEIGHTS["tag"]
    permissive = all(evaluate(p, allowed) for p in expressions) if expressions else None
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - doubt, ";".join(" ".join(p) for p in expressions), permissive


def scan_licenses(docs: DataFrame, permitted: tuple[str, ...] = PERMISSIVE) -> DataFrame:
    """A row per document; expressions are in postfix order, permissive says whether permitted ids satisfy all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, allowed = automaton(), frozenset(permitted).__contains__
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())
        for b in batches:
            rows = [scan(t.as_py(), find, allowed) for t in b.column("text")]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text")).mapInArrow(run, SCHEMA)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.load(spark, sf_dir, "documents"))
