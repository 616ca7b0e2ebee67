"""Text measures as native column expressions.

Regexes carry ``(?U)`` so that ``\\w \\b \\d \\s`` are Unicode-aware, and the
whitespace class adds the four separators that Unicode's own set leaves out.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"

#: The same characters one by one: Unicode white space and the four separators.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column captured by a higher-order function's lambda is otherwise evaluated
    again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Sequence[str]) -> Column:
    """A constant string array, parsed from one SQL literal list."""
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"CAST(array({', '.join(quoted)}) AS ARRAY<STRING>)")


def pattern(regex: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + regex


def strip(c: Column | str) -> Column:
    """Without outer white space; looks at the ends of the text only."""
    return F.btrim(_col(c), F.lit(SPACES))


def words(c: Column | str) -> Column:
    """Whitespace-separated tokens; null gives none."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), f"(?U){SPACE}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def unique_words_ratio(c: Column | str) -> Column:
    """Distinct over all lower-cased tokens, 0.0 without tokens."""
    return let(words(F.lower(_col(c))), distinct_share)


def distinct_share(tokens: Column) -> Column:
    return F.when(
        F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)
    ).otherwise(F.lit(0.0))


def hapax_ratio(c: Column | str) -> Column:
    """Tokens seen exactly once over all tokens, by one sort per text."""

    def once(s: Column) -> Column:
        lone = F.filter(
            s,
            lambda w, i: ~F.get(s, i - 1).eqNullSafe(w) & ~F.get(s, i + 1).eqNullSafe(w),
        )
        return F.when(F.size(s) > 0, F.size(lone) / F.size(s)).otherwise(F.lit(0.0))

    return let(F.sort_array(words(F.lower(_col(c)))), once)


def normalize_text(c: Column | str) -> Column:
    """Lower case, single spaces, and only word characters or basic punctuation."""
    lowered = strip(F.lower(F.coalesce(_col(c), F.lit(""))))
    spaced = F.regexp_replace(lowered, f"(?U){SPACE}+", " ")
    return F.regexp_replace(spaced, r"(?U)[^\w\s.,;:!?'-]", "")


def sentence_lengths(c: Column | str) -> Column:
    """Word count of each non-blank piece between ``.``, ``!`` and ``?`` runs."""
    pieces = F.split(F.coalesce(_col(c), F.lit("")), "[.!?]+")
    return F.filter(F.transform(pieces, word_count), lambda n: n > 0)


def coef_variation(numbers: Column) -> Column:
    """Population standard deviation over mean; 0 when the mean is 0 or there is none."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def spread(xs: Column, mean: Column) -> Column:
        squares = F.transform(xs, lambda x: (x - mean) * (x - mean))
        return F.sqrt(total(squares) / F.size(xs))

    def ratio(xs: Column) -> Column:
        return let(
            total(xs) / F.size(xs),
            lambda mean: F.when(mean > 0, spread(xs, mean) / mean).otherwise(F.lit(0.0)),
        )

    return F.when(F.size(numbers) > 0, let(numbers, ratio)).otherwise(F.lit(0.0))


def needed_mark(regex: str) -> str | None:
    """A mark (``@``, ``%`` and the like) that every match of a regex without alternatives or groups has."""
    if re.search(r"[|()]", regex):
        return None
    bare = re.sub(r"\\.|\[\^?\]?(\\.|[^]\\])*\]", "a", regex)
    bare = re.sub(r".\{[^}]*\}", "a", bare)
    return next((m for m in re.findall(r"[@%#&<>=/:;,!~](?![?*{])", bare)), None)


def regex_hits(c: Column | str, regex: str, ignore_case: bool = False) -> Column:
    """Number of non-overlapping matches; a text without a mark that they need is not scanned."""
    hits = F.regexp_count(_col(c), F.lit(pattern(regex, ignore_case)))
    mark = needed_mark(regex)
    return hits if mark is None else F.when(~F.contains(_col(c), F.lit(mark)), 0).otherwise(hits)


def regex_any(c: Column | str, regex: str, ignore_case: bool = False) -> Column:
    """Whether the regex matches; plain alternatives become substring tests."""
    plain = regex.split("|")
    if not ignore_case and all(re.fullmatch(r"[\w '-]+", alternative) for alternative in plain):
        return functools.reduce(
            operator.or_, [F.contains(_col(c), F.lit(alternative)) for alternative in plain])
    return _col(c).rlike(pattern(regex, ignore_case))


def folds(regex: str) -> bool:
    """Whether matching lower-cased text equals ignoring case: no upper-case literal."""
    return not re.search(r"[A-Z]", re.sub(r"\\.", "", regex))


def folded(c: Column) -> Column:
    """Lower case for case-blind matching, with the long s and dotless i as s and i."""
    rare = F.contains(c, F.lit("ſ")) | F.contains(c, F.lit("ı"))
    return F.when(rare, F.translate(F.lower(c), "ſı", "si")).otherwise(F.lower(c))


def contraction_rate(c: Column | str, regex: str) -> Column:
    """Matches of ``regex`` per word of the lower-cased text."""
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    return let(
        lowered, lambda t: regex_hits(t, regex) / F.greatest(word_count(t), F.lit(1))
    )


def phrases_found(c: Column | str, phrases: Sequence[str] | Column) -> Column:
    """The distinct phrases that occur in the text as substrings, in list order."""
    if isinstance(phrases, Column):
        listed = F.array_distinct(phrases)
    else:
        listed = strings(list(dict.fromkeys(phrases)))
    return let(_col(c), lambda t: F.filter(listed, lambda p: F.contains(t, p)))


def phrase_hits(c: Column | str, phrases: Sequence[str]) -> Column:
    """How many distinct phrases occur as substrings."""
    return F.size(phrases_found(c, phrases))


def patterns_present(c: Column | str, regexes: Sequence[str], ignore_case: bool = False) -> Column:
    """How many of the regexes match at least once."""
    return add_up([regex_any(c, r, ignore_case).cast("int") for r in regexes])


def preview(c: Column | str, chars: int = 100) -> Column:
    return F.substring(_col(c), 1, chars)


def first_name(c: Column | str, default: str = "there") -> Column:
    return F.coalesce(F.get(words(c), F.lit(0)), F.lit(default))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Round the exact binary value, ties to even, as Python's ``round`` does.

    ``bround`` looks at the shortest decimal form instead, so that 2.675, which is a
    little less than it looks, would go up.  Here ``x * 2 * 10**digits`` is compared
    with the odd number between its two roundings; when the product hides the
    difference, its rounding error, recovered exactly by splitting ``x``, decides.
    """
    x = _col(c).cast("double")
    scale = float(2 * 10 ** digits)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product / 2.0).cast("double")
    middle = below * 2.0 + 1.0
    side = F.when(product != middle, product - middle).otherwise(error)
    up = (side > 0) | ((side == 0) & (below % 2.0 != 0))
    rounded = F.when(up, below + 1.0).otherwise(below) / float(10 ** digits)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0 ** 52), x).when(
        F.abs(x) > 1e11, _round_large(x, digits)).otherwise(rounded)


def _round_large(x: Column, digits: int) -> Column:
    """The same where the scaled value has too many digits: only the fraction, which a
    double of this size holds exactly, is rounded, and the text of both is read back."""
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    # Exact: part has at most 52 bits behind the point of a number above 2**36.
    scaled = part.cast("decimal(38,20)") * F.lit(10 ** digits).cast("decimal(5,0)")
    low = F.floor(scaled).cast("bigint")
    half = F.lit("0.5").cast("decimal(38,20)")
    rest = (scaled - low.cast("decimal(18,0)")).cast("decimal(38,20)")
    odd = (low % 2 != 0) if digits else (whole % 2 != 0)
    units = low + F.when((rest > half) | ((rest == half) & odd), 1).otherwise(0)
    one = 10 ** digits
    shown = F.concat((whole + F.floor(units / one)).cast("string"), F.lit("."),
                     F.lpad((units % one).cast("string"), max(1, digits), "0"))
    return F.when(x < 0, -shown.cast("double")).otherwise(shown.cast("double"))


def fixed(c: Column | str, digits: int) -> Column:
    """A number with exactly ``digits`` decimals, correctly rounded."""
    return F.format_string(f"%.{digits}f", round_half_even(c, digits))


def add_up(terms: Sequence[Column]) -> Column:
    out = F.lit(0)
    for term in terms:
        out = out + term
    return out


def ladder_below(value: Column, steps: Sequence[tuple], otherwise) -> Column:
    """First step whose bound is above ``value``."""
    out = F
    for bound, result in steps:
        out = out.when(value < bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def ladder_at_least(value: Column, steps: Sequence[tuple], otherwise) -> Column:
    """First step whose bound ``value`` reaches."""
    out = F
    for bound, result in steps:
        out = out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def ladder_at_most(value: Column, steps: Sequence[tuple], otherwise) -> Column:
    """First step whose bound is not below ``value``."""
    out = F
    for bound, result in steps:
        out = out.when(value <= bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def number_text(c: Column) -> Column:
    """A double as text with at least one decimal; plain digits from 1e-4 to below 1e15."""
    plain = F.regexp_replace(c.cast("decimal(38,21)").cast("string"), "0+$", "")
    whole = F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when((c == F.floor(c)) & (F.abs(c) < 1e15), whole)
        .when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e15), plain)
        .otherwise(c.cast("string"))
    )
