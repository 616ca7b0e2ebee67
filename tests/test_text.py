import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as tx

TEXTS = ["", None, "   ", "one", "One two  two\tthree\n", "don't l'été can't", "a b c a b d e", "Ünï cödé x\x1cy. Z! w?"]


def values(spark, column, rows=TEXTS):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, t STRING")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_word_count(spark):
    assert values(spark, tx.word_count("t")) == [len((t or "").split()) for t in TEXTS]


def test_unique_and_hapax(spark):
    def share(t):
        w = (t or "").lower().split()
        return len(set(w)) / len(w) if w else 0.0

    def lone(t):
        w = (t or "").lower().split()
        return sum(w.count(x) == 1 for x in w) / len(w) if w else 0.0

    assert values(spark, tx.unique_words_ratio("t")) == [share(t) for t in TEXTS]
    assert values(spark, tx.hapax_ratio("t")) == [lone(t) for t in TEXTS]


def test_sentences_and_variation(spark):
    texts = ["One two. Three four five! Six?", "...", "no end", "a b c. a b c. a b c."]
    assert values(spark, tx.sentence_lengths("t"), texts) == [[2, 3, 1], [], [2], [3, 3, 3]]
    cv = values(spark, tx.coef_variation(tx.sentence_lengths("t")), texts)
    assert cv[0] == pytest.approx(math.sqrt(2 / 3) / 2) and cv[1:] == [0.0, 0.0, 0.0]


def test_contractions_are_unicode(spark):
    got = values(spark, tx.contraction_rate("t", r"\b\w+'\w+\b"), ["l'été don't x y", "", None])
    assert got == [0.5, 0.0, 0.0]


def test_normalize_strip_first_name_preview(spark):
    assert values(spark, tx.normalize_text("t"), ["  A\tB #c! "]) == ["a b c!"]
    assert values(spark, tx.strip("t"), ["\x1c  a b \n"]) == ["a b"]
    assert values(spark, tx.first_name("t"), ["Ann Lee", "", None]) == ["Ann", "there", "there"]
    assert values(spark, tx.preview("t"), ["x" * 150]) == ["x" * 100]


def test_phrases_keep_list_order_and_quotes(spark):
    got = values(spark, tx.phrases_found("t", ["it's", "b\\c", "a", "a", "zz"]), ["a it's b\\c", "none", ""])
    assert got == [["it's", "b\\c", "a"], [], []]
    assert values(spark, tx.phrase_hits("t", ["a", "a", "b"]), ["ab", "b", None])[:2] == [2, 1]


def test_plain_alternatives_equal_regex(spark):
    texts = ["we tried", "retried it", "nothing", "didn't work"]
    regex = "tried|didn't work"
    assert values(spark, tx.regex_any("t", regex), texts) == values(
        spark, F.col("t").rlike(regex), texts) == [True, True, False, True]
    assert not tx.folds(r"\b\d+K\b") and tx.folds(r"\B\D+k")


def test_round_half_even_is_python_round(spark):
    rng = random.Random(5)
    numbers = [2.675, 0.125, 0.375, 91.125, 11.175, 76.475, 40.785, -2.675, -0.125, 0.0, 1e-9, 1e12, 100.0]
    numbers += [rng.randrange(0, 20000) / 200 for _ in range(400)] + [rng.uniform(-100, 100) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in numbers], "x DOUBLE")
    for digits in (0, 2, 3, 4):
        rows = df.select("x", tx.round_half_even("x", digits).alias("r"), tx.fixed("x", digits).alias("f")).collect()
        assert [r.r for r in rows] == [round(r.x, digits) for r in rows]
        assert [r.f for r in rows if abs(r.x) < 1e10 and r.f.strip("-0.") != ""] == [
            f"{r.x:.{digits}f}" for r in rows if abs(r.x) < 1e10 and r.f.strip("-0.") != ""]


def test_number_text(spark):
    df = spark.createDataFrame([(3.0,), (2.5,), (2e7,), (float("nan"),)], "x DOUBLE")
    assert [r[0] for r in df.select(tx.number_text(F.col("x"))).collect()] == ["3.0", "2.5", "20000000.0", "nan"]


def test_rounding_of_large_numbers(spark):
    import random
    rng = random.Random(1)
    values = [1e11 + 0.005, 123456789012.125, 123456789012.375, 2.0 ** 51 + 0.5, 2.0 ** 51 + 1.5, 1e12 + 0.9999, -123456789012.625, 1e18]
    values += [rng.uniform(1e11, 4e15) for _ in range(500)] + [-rng.uniform(1e11, 1e13) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in df.select(tx.round_half_even("x", digits)).collect()]
        assert got == [float(round(v, digits)) for v in values]


def test_number_text_has_no_exponent(spark):
    df = spark.createDataFrame([(v,) for v in (12345678.5, 0.0005, 123456789012.25, -98765432.125)], "x double")
    assert [r[0] for r in df.select(tx.number_text(F.col("x"))).collect()] == ["12345678.5", "0.0005", "123456789012.25", "-98765432.125"]


def test_regex_hits_skip_texts_without_a_mark_they_need(spark):
    assert [tx.needed_mark(r) for r in (r"[a-z]+@[a-z]+", r"\d+%", r"a@+", r"ing[,.]", r"a%?b", r"x{1,2}y", r"a%{0,2}", r"a@|b", r"[]@]b", r"a\@b")] == [
        "@", "%", "@", None, None, None, None, None, None, None]
    rows = spark.createDataFrame([("a@b c@d",), ("a b",), ("",), (None,)], "t STRING").select(tx.regex_hits("t", r"[a-z]+@[a-z]+").alias("n"))
    assert [r["n"] for r in rows.collect()] == [2, 0, 0, None]
