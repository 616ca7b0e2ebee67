"""Licence scans: Aho-Corasick over words finds notices and identifier tags; a shunting-yard
parser evaluates the and/or/with expressions that follow a tag.

A text is folded to its words with single spaces around them, so one automaton pass finds
every phrase at word boundaries, overlapping ones included, in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import batches, rows_of

# Phrases of the base result and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases that the method adds, in folded words.
NOTICES = {
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc", "cc0": "public-domain", "public domain": "public-domain",
    "creative commons attribution": "cc-by", "creative commons zero": "public-domain", "the unlicense": "public-domain",
    "mit license": "mit", "mit licence": "mit", "apache license": "apache", "apache licence": "apache",
    "bsd license": "bsd", "bsd licence": "bsd", "isc license": "isc", "boost software license": "boost",
    "mozilla public license": "mpl", "eclipse public license": "epl", "general public licence": "gpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "proprietary and confidential": "reserved", "no part of this publication may be reproduced": "reserved",
}

#: Tags with an expression behind them.
TAGS = ("spdx license identifier", "license expression")

#: Licence identifiers by their beginning; the longest that fits counts.
FAMILIES = {
    "mit": "mit", "x11": "mit", "apache": "apache", "bsd": "bsd", "0bsd": "public-domain", "isc": "isc", "bsl-1.0": "boost",
    "mpl": "mpl", "epl": "epl", "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl", "cc0": "public-domain",
    "unlicense": "public-domain", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
}

#: How freely a text under each label may be used, from 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "boost": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6,
    "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2,
    "other": 0.1, "reserved": 0.0,
}
#: What an exception lifts a copyleft licence to.
EXCEPTED = 0.6

#: Bytes outside words become spaces; A-Z is lower-cased first.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
             for b in range(256))
_APART = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
TAG = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(_APART.join(t.encode().split()) for t in TAGS)
                 + rb")(?![0-9a-z\x80-\xff])")
#: What may stand between a tag and its expression, and the expression's tokens on that line.
BEHIND = re.compile(rb"[\"']?[ \t]*[:=]?[ \t]*[\"']?")
TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z][0-9a-z.:+-]*)")
RANK = {"or": 1, "and": 2, "with": 3}

Value = tuple[frozenset, float]


def licence(identifier: str) -> Value:
    """Label and freedom of one identifier; one of no known family is ``other``."""
    start = max((f for f in FAMILIES if identifier.startswith(f)), key=len, default=None)
    label = FAMILIES[start] if start else "other"
    return frozenset([label]), FREEDOM[label]


def combine(operator: str, a: Value, b: Value) -> Value:
    """Either licence may be chosen under ``or``, both bind under ``and``, and ``with`` names
    an exception, which lifts copyleft."""
    if operator == "with":
        return a[0], max(a[1], EXCEPTED)
    return a[0] | b[0], (max if operator == "or" else min)(a[1], b[1])


def tokens_at(data: bytes, at: int) -> list[str]:
    """Tokens of the expression that starts at ``at``, to the first that cannot follow."""
    found: list[str] = []
    depth, operand = 0, True  # operand: one is due next
    while met := TOKEN.match(data, at):
        token = met[1].decode()
        if token == "(" or (token not in RANK and token != ")"):
            if not operand:
                break
            depth += token == "("
            operand = token == "("
        else:
            if operand or (token == ")" and not depth):
                break
            depth -= token == ")"
            operand = token != ")"
        found.append(token)
        at = met.end()
    return found


def evaluate(tokens: list[str]) -> Value | None:
    """Labels and freedom of an expression, by shunting-yard; None where there is no operand.

    An expression that stops short (a missing operand or parenthesis) is read as far as it
    goes: what is open is closed, an operator without its right side is left out.
    """
    values: list[Value] = []
    waiting: list[str] = []

    def reduce() -> None:
        operator = waiting.pop()
        if operator in RANK:
            b = values.pop()
            values.append(combine(operator, values.pop(), b))

    stop = len(tokens)
    while stop and (tokens[stop - 1] in RANK or tokens[stop - 1] == "("):
        stop -= 1
    for token in tokens[:stop]:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
        elif token in RANK:
            while waiting and RANK.get(waiting[-1], 0) >= RANK[token]:
                reduce()
            waiting.append(token)
        else:
            values.append(licence(token))
    while waiting:
        reduce()
    return values[0] if values else None


class Scanner:
    """One automaton over all phrases and tags; ``scan`` gives the result of one text."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, label in [*NOTICES.items(), *BASE.items(), *[(t, None) for t in TAGS]]:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple:
        data = (text or b"").translate(FOLD)
        words = data.split()
        folded = (b" %b " % b" ".join(words)).decode("latin-1")  # phrases are ASCII; a byte stays one character
        starts, tagged = [], False
        base: set[str] = set()
        labels: set[str] = set()
        for end, (length, label, is_base) in self.automaton.iter(folded):
            if label is None:
                tagged = True
                continue
            labels.add(label)
            if is_base:
                base.add(label)
                starts.append(end + 1 - length)
        freedom = [FREEDOM[x] for x in labels]
        if tagged:  # the folded text has lost the parentheses, so tags are met again in the text
            lower = (text or b"").lower()
            for tag in TAG.finditer(lower):
                value = evaluate(tokens_at(lower, BEHIND.match(lower, tag.end()).end()))
                if value:
                    labels |= value[0]
                    freedom.append(value[1])
        first = last = None
        if starts:
            first, last = (folded.count(" ", 0, at) for at in (min(starts), max(starts)))
        score = 1.0 - min(freedom, default=1.0)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  ``n_base``
    counts every place of a base phrase, overlapping ones too; ``first_word`` and ``last_word``
    are the least and largest word number (from 0) where one starts, null if there is none.
    ``base_labels`` and ``labels`` are distinct, sorted and comma-joined, empty if there are
    none; ``labels`` also has what other notices and the expressions behind tags name.
    ``score`` is the restriction: 1 less the least freedom of all notices and expressions
    found, 0 where nothing is found.  In an expression ``or`` takes the freer side, ``and``
    the stricter, ``with`` lifts copyleft.

    A null or empty text has no words.  Rows are independent: null, tied or repeated ids keep
    their rows, other columns are ignored, whatever their names, and an empty table gives no
    rows.  Whole texts are scanned in one pass, nothing is exchanged.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner().scan
        for part in parts:
            for batch in batches(rows_of(part, 0, 1), 1):
                found = list(zip(*[scan(text) for _, text in batch]))
                keys = pa.array([key for key, _ in batch], part.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, found, kinds)], names=schema.names)

    return rows.mapInArrow(task, schema)
