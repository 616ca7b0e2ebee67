import random
import re

import pytest

from sievework.llm import licenses as lc
from sievework.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    """The base columns, word by word."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(k, label) for phrase, label in lc.BASE.items() for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


TEXTS = [None, "", " ", "CC BY", "cc-by cc by", "CC BY CC BY cc", "xcc by", "cc byx", "ALL Rights\nreserved.",
         "the GNU General  Public—License", "general public license, general public license", "É cc by É", "cc by",
         "İ cc by ı", "K cc by", "a\x00cc\x7fby", "word " * 50000 + "cc by"]


def test_base_columns_equal_a_plain_search():
    rng = random.Random(5)
    parts = ["cc", "by", "CC", "General", "public", "license", "all", "rights", "reserved", " ", "-", "\n", "é", "x", ". "]
    texts = TEXTS + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    scanner = lc.Scanner()
    for text in texts:
        got = scanner.scan(text.encode() if text is not None else None)
        assert got[:5] == plain(text), text
        assert 0 <= got[6] <= 1 and set(filter(None, got[4].split(","))) <= set(got[5].split(","))


@pytest.mark.parametrize("expression, labels, freedom", [
    ("MIT", "mit", 0.9), ("MIT OR GPL-2.0-only", "gpl,mit", 0.9), ("MIT AND GPL-2.0-only", "gpl,mit", 0.4),
    ("MIT OR GPL-3.0 AND AGPL-3.0", "agpl,gpl,mit", 0.9), ("(MIT OR GPL-3.0) AND AGPL-3.0", "agpl,gpl,mit", 0.3),
    ("GPL-2.0+ WITH Classpath-exception-2.0", "gpl", 0.6), ("GPL-2.0 WITH x AND CC-BY-NC-4.0", "cc-by,cc-by-nc,gpl", 0.2),
    ("((Apache-2.0))", "apache", 0.9), ("Foo-1.0", "other", 0.1), ("MIT OR", "mit", 0.9), ("(MIT OR (GPL-2.0", "gpl,mit", 0.9),
    ("MIT some words", "mit", 0.9), ("LGPL-2.1 OR\nMIT", "lgpl", 0.6), (") MIT", None, None), ("OR", None, None), ("", None, None),
    ("MIT) AND GPL-2.0", "mit", 0.9)])
def test_expressions(expression, labels, freedom):
    for tag in ("// SPDX-License-Identifier: ", "spdx license identifier = ", 'License-Expression: '):
        got = lc.Scanner().scan(f"text\n{tag}{expression}\nmore".encode())
        assert got[5] == (labels or "")
        assert got[6] == pytest.approx(1 - freedom if freedom is not None else 0.0)


def test_deep_and_long_expressions():
    deep = "(" * 3000 + "MIT" + ")" * 3000
    wide = " AND ".join(["MIT"] * 20000 + ["GPL-2.0"])
    assert lc.Scanner().scan(f"SPDX-License-Identifier: {deep}".encode())[5] == "mit"
    assert lc.Scanner().scan(f"SPDX-License-Identifier: {wide}".encode())[5] == "gpl,mit"


def test_notices():
    got = lc.Scanner().scan(b"Licensed under CC BY-NC 4.0. Released under the MIT License. cc by")
    assert (got[1], got[4], got[5], got[6]) == (2, "cc-by", "cc-by,cc-by-nc,mit", pytest.approx(0.8))


def test_rows_stay_as_they_are(spark, documents):
    docs = documents((1, "cc by"), (1, "cc by"), (None, None), (3, ""), (4, "x"))
    got = sorted(tuple(r) for r in lc.scan_licenses(docs).fillna({"doc_id": -1}).collect())
    assert [r[:3] for r in got] == [(-1, 0, 0), (1, 2, 1), (1, 2, 1), (3, 0, 0), (4, 1, 0)]
    assert lc.scan_licenses(docs.limit(0)).count() == 0


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_licenses"](spark, FOLDER).collect()}
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(texts) == len(got) and any(r["n_base"] for r in got.values())
    for doc_id, text in texts:
        assert tuple(got[doc_id])[1:6] == plain(text)
