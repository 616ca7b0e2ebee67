"""Scoring, forensics and reply rules as column expressions.

Each rule sees one row.  ``answers`` is ``ARRAY<STRUCT<question_id, question_text,
answer_text>>`` in question order, so no rule needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import lexicons as lx
from sievework.functions import text as tx
from sievework.functions.text import let


def _double(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def _kept(*items: Column) -> Column:
    """The non-null strings of ``items``, in order."""
    return F.filter(F.array(*items), lambda s: s.isNotNull())


# ------------------------------------------------------------------- texts


def joined_answers(answers: Column | str, lower: bool = True, keep_empty: bool = True) -> Column:
    """All answers of a row as one text, in question order."""
    column = F.col(answers) if isinstance(answers, str) else answers
    texts = F.transform(column, lambda a: F.coalesce(a["answer_text"], F.lit("")))
    if not keep_empty:
        texts = F.filter(texts, lambda t: t != "")
    joined = F.coalesce(F.array_join(texts, " "), F.lit(""))
    return F.lower(joined) if lower else joined


def total_words(answers: Column | str) -> Column:
    column = F.col(answers) if isinstance(answers, str) else answers
    return F.aggregate(
        column, F.lit(0), lambda acc, a: acc + tx.word_count(a["answer_text"])
    )


def answer_shapes(answers: Column | str) -> Column:
    """``n`` tokens and the ``share`` of distinct ones of each answer, in lower case."""
    column = F.col(answers) if isinstance(answers, str) else answers
    return F.transform(column, lambda a: let(tx.words(F.lower(a["answer_text"])), lambda tokens: F.struct(
        F.size(tokens).alias("n"), tx.distinct_share(tokens).alias("share"))))


# -------------------------------------------------------------- dimensions

#: ``lx.VERSION_PATTERN`` with the same matches, but each run of letters is tried once
#: instead of from every letter and every length.
VERSION_SCAN = "(?<![a-zA-Z])" + lx.VERSION_PATTERN.replace("[a-zA-Z]+", "[a-zA-Z]++", 1)


def role_key(role: Column | str) -> Column:
    column = F.col(role) if isinstance(role, str) else role
    return F.replace(F.lower(F.coalesce(column, F.lit(""))), F.lit(" "), F.lit("_"))


def role_terms(role: Column | str, lexicon: Mapping[str, Sequence[str]] = lx.ROLE_TERMS,
               default: str = lx.DEFAULT_ROLE) -> Column:
    """The role's term list; the default role's for an unknown role."""
    def listed(terms):
        return tx.strings(list(dict.fromkeys(terms)))

    fallback = listed(lexicon.get(default, []))
    chosen = F
    key = role_key(role)
    for name, terms in lexicon.items():
        if name != default:
            chosen = chosen.when(key == name, listed(terms))
    return chosen.otherwise(fallback) if chosen is not F else fallback


def terms_in(text: Column | str, terms: Column, word_boundary: bool = False) -> Column:
    """Distinct terms found in ``text``, as substrings or, on request, as whole words."""
    if not word_boundary:
        return tx.phrases_found(text, terms)
    column = F.col(text) if isinstance(text, str) else text
    tokens = F.split(column, r"(?U)[^\w/-]+")
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return let(padded, lambda t: F.filter(
        F.array_distinct(terms),
        lambda term: F.contains(t, F.concat(F.lit(" "), term, F.lit(" "))),
    ))


def version_hits(text: Column | str) -> Column:
    """Number of version-like tokens."""
    return tx.regex_hits(text, VERSION_SCAN)


def technical_relevance(text: Column | str, n_found: Column, n_versions: Column | None = None) -> Column:
    """Ladder over the distinct terms, plus points per version-like token, at most 100.

    ``n_versions`` takes the place of ``version_hits`` where it is known.
    """
    base = tx.ladder_at_least(n_found, lx.TERM_LADDER, lx.TERM_FLOOR)
    bonus = (version_hits(text) if n_versions is None else n_versions) * lx.VERSION_POINTS
    return F.when(tx.strip(text) == "", _double(0)).otherwise(
        _double(F.least(F.lit(100), base + bonus))
    )


def answer_points(answer: Column | str, rules=lx.QUALITY_RULES, shape: Column | None = None) -> Column:
    """Points of one answer: length, vocabulary, and each structural pattern present.

    ``shape`` is the answer's of ``answer_shapes``, where it is known.
    """
    column = F.col(answer) if isinstance(answer, str) else answer

    def present(regex: str, lowered: Column) -> Column:
        if tx.folds(regex):
            return tx.regex_any(lowered, regex)
        return tx.regex_any(column, regex, ignore_case=True)

    def bonuses(lowered: Column) -> Column:
        return tx.add_up([
            F.when(present(regex, lowered), float(bonus * lx.QUALITY_FACTOR)).otherwise(0.0)
            for regex, bonus in rules
        ])

    def points(n: Column, distinct: Column) -> Column:
        length = tx.ladder_at_most(n, lx.LENGTH_LADDER, lx.LENGTH_TOP)
        variety = let(distinct, lambda share: F.when(share > 0.7, 10).when(share < 0.4, -10).otherwise(0))
        return F.when(n == 0, _double(0)).otherwise(
            _double(length + variety) + let(tx.folded(column), bonuses)
        )

    if shape is not None:
        return points(shape["n"], shape["share"])
    return let(tx.words(F.lower(column)), lambda tokens: points(F.size(tokens), tx.distinct_share(tokens)))


def answer_quality(answers: Column | str, rules=lx.QUALITY_RULES, shapes: Column | None = None) -> Column:
    """Mean points over all answers, empty ones included, within 0..100."""
    column = F.col(answers) if isinstance(answers, str) else answers
    if shapes is None:
        points = F.transform(column, lambda a: answer_points(a["answer_text"], rules))
    else:
        points = F.zip_with(column, shapes, lambda a, shape: answer_points(a["answer_text"], rules, shape))
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(column) > 0, tx.clamp(total / F.size(column), 0.0, 100.0)).otherwise(
        _double(0)
    )


def handle_is_fake(url: Column | str, tokens=lx.FAKE_HANDLE_TOKENS) -> Column:
    """Whether the last path segment contains a placeholder token."""
    column = F.col(url) if isinstance(url, str) else url
    last = F.element_at(F.split(F.lower(column), "/"), -1)
    return F.size(tx.phrases_found(last, tokens)) > 0


def profile_credibility(github: Column | str, linkedin: Column | str, text: Column | str,
                        fake_tokens=lx.FAKE_HANDLE_TOKENS,
                        work_references=lx.WORK_REFERENCES) -> Column:
    gh = F.col(github) if isinstance(github, str) else github
    li = F.col(linkedin) if isinstance(linkedin, str) else linkedin
    cites_work = tx.phrase_hits(text, work_references) > 0
    from_github = (
        F.when(F.coalesce(gh, F.lit("")) == "", -10)
        .when(handle_is_fake(gh, fake_tokens), -20)
        .otherwise(F.when(cites_work, 30).otherwise(20))
    )
    from_linkedin = F.when(F.coalesce(li, F.lit("")) == "", -5).otherwise(15)
    return tx.clamp(_double(50 + from_github + from_linkedin), 0.0, 100.0)


def evidence_hits(text: Column | str, patterns=lx.CONCRETE_PATTERNS) -> Column:
    """Number of matches of each kind of concrete evidence, in the order of ``patterns``."""
    hits = [tx.regex_hits(text, regex, ignore_case=not tx.folds(regex)) for regex, _ in patterns]
    return F.array(*hits).cast("array<int>")


def specificity(text: Column | str, phrases=lx.GENERIC_PHRASES, patterns=lx.CONCRETE_PATTERNS,
                found: Column | None = None, evidence: Column | None = None) -> Column:
    """60, minus 8 per generic phrase, plus at most 15 per kind of concrete evidence.

    ``found`` phrases and ``evidence`` hits take the place of the text where they are known.
    """
    penalty = (tx.phrase_hits(text, phrases) if found is None else F.size(found)) * 8
    bonus = tx.add_up([
        F.least(F.lit(15), (tx.regex_hits(text, regex, ignore_case=not tx.folds(regex))
                            if evidence is None else F.get(evidence, F.lit(i))) * 5)
        for i, (regex, _) in enumerate(patterns)
    ])
    return tx.clamp(_double(60 + bonus - penalty), 0.0, 100.0)


def timing_score(seconds: Column | str) -> Column:
    column = F.col(seconds) if isinstance(seconds, str) else seconds
    ladder = tx.ladder_below(column, lx.TIMING_LADDER, lx.TIMING_NEUTRAL)
    return F.when(column <= 0, _double(lx.TIMING_NEUTRAL)).otherwise(_double(ladder))


def weighted_total(weights: Mapping[str, float] = lx.WEIGHTS) -> Column:
    """Sum of dimension times weight in a fixed order."""
    return tx.add_up([F.col(d) * float(weights[d]) for d in lx.DIMENSIONS if d in weights])


def all_minimal(answers: Column | str, shapes: Column | None = None) -> Column:
    """Every answer has at most five words; true without answers."""
    column = F.col(answers) if isinstance(answers, str) else answers
    if shapes is not None:
        few = F.forall(shapes, lambda shape: shape["n"] <= 5)
    else:
        few = F.forall(column, lambda a: tx.word_count(a["answer_text"]) <= 5)
    return F.coalesce(few, F.lit(True))


def penalty_flags(email: Column | str, answers: Column | str, shapes: Column | None = None) -> Column:
    column = F.col(email) if isinstance(email, str) else email
    return _kept(
        F.when(F.coalesce(column, F.lit("")) == "", F.lit("MISSING_EMAIL")),
        F.when(all_minimal(answers, shapes), F.lit("ALL_MINIMAL_ANSWERS")),
    )


def penalised(total: Column | str, flags: Column | str) -> Column:
    column = F.col(total) if isinstance(total, str) else total
    halved = column * F.when(F.array_contains(flags, "MISSING_EMAIL"), 0.5).otherwise(1.0)
    return halved * F.when(F.array_contains(flags, "ALL_MINIMAL_ANSWERS"), 0.3).otherwise(1.0)


def tier(total: Column | str, flags: Column | str, ladder=lx.TIER_LADDER) -> Column:
    """Tier of an unrounded total; a hard-reject flag wins."""
    column = F.col(total) if isinstance(total, str) else total
    hard = F.arrays_overlap(
        F.col(flags) if isinstance(flags, str) else flags,
        tx.strings(lx.REJECT_FLAGS),
    )
    return F.when(F.coalesce(hard, F.lit(False)), F.lit("Reject")).otherwise(
        tx.ladder_at_least(column, ladder, "Reject")
    )


# ------------------------------------------------------------- explanations


def explain_terms(text: Column | str, found: Column | str, n_versions: Column | None = None) -> Column:
    column = F.col(found) if isinstance(found, str) else found
    blank = tx.strip(text) == ""
    listed = F.array_join(F.slice(F.sort_array(column), 1, 10), ", ")
    return F.when(blank, F.array(F.lit("No answer text provided"))).otherwise(_kept(
        F.concat(F.lit("Found "), F.size(column).cast("string"), F.lit(" technical terms: "), listed),
        F.when(tx.regex_any(text, VERSION_SCAN) if n_versions is None else n_versions > 0,
               F.lit("Mentions specific versions/numbers: shows precision")),
    ))


def explain_answers(answers: Column | str, shapes: Column | None = None) -> Column:
    column = F.col(answers) if isinstance(answers, str) else answers

    def notes(a: Column, shape: Column | None = None) -> Column:
        head = F.concat(F.lit("Q '"), a["question_id"], F.lit("': "))

        def of_shape(n: Column, share: Column) -> Column:
            count = n.cast("string")
            return _kept(
                F.when(n == 0, F.concat(head, F.lit("Empty answer")))
                .when(n <= 5, F.concat(head, F.lit("Extremely short ("), count, F.lit(" words)")))
                .when(n <= 20, F.concat(head, F.lit("Brief response ("), count, F.lit(" words)")))
                .when(n > 150, F.concat(head, F.lit("Detailed response ("), count, F.lit(" words)"))),
                F.when((n > 0) & (share < 0.4), F.concat(
                    head, F.lit("Repetitive vocabulary (ratio: "),
                    tx.fixed(share, 2), F.lit(")"))),
            )

        if shape is not None:
            return of_shape(shape["n"], shape["share"])
        return let(tx.words(F.lower(a["answer_text"])), lambda tokens: of_shape(F.size(tokens), tx.distinct_share(tokens)))

    noted = F.transform(column, lambda a: notes(a)) if shapes is None else F.zip_with(column, shapes, notes)
    return F.when(F.size(column) > 0, F.flatten(noted)).otherwise(
        F.array(F.lit("No answers to evaluate"))
    )


def explain_profile(github: Column | str, linkedin: Column | str, text: Column | str) -> Column:
    gh = F.col(github) if isinstance(github, str) else github
    li = F.col(linkedin) if isinstance(linkedin, str) else linkedin
    missing = F.coalesce(gh, F.lit("")) == ""
    fake = handle_is_fake(gh)
    return _kept(
        F.when(missing, F.lit("No GitHub profile provided"))
        .when(fake, F.concat(F.lit("GitHub URL looks suspicious: "), gh))
        .otherwise(F.concat(F.lit("GitHub profile provided: "), gh)),
        F.when(~missing & ~fake & (tx.phrase_hits(text, lx.WORK_REFERENCES) > 0),
               F.lit("References GitHub work in answers")),
        F.when(F.coalesce(li, F.lit("")) == "", F.lit("No LinkedIn profile"))
        .otherwise(F.lit("LinkedIn profile provided")),
    )


def explain_specificity(text: Column | str, phrases=lx.GENERIC_PHRASES, patterns=lx.CONCRETE_PATTERNS,
                        found: Column | None = None, evidence: Column | None = None) -> Column:
    def of_found(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(
            F.lit("Found "), F.size(found).cast("string"), F.lit(" generic phrases: "),
            F.array_join(F.slice(found, 1, 5), ", ")))

    def shown(i: int, regex: str, what: str) -> Column:
        hits = tx.regex_hits(text, regex, ignore_case=not tx.folds(regex)) if evidence is None else F.get(evidence, F.lit(i))
        return let(hits, lambda n: F.when(
            n > 0, F.concat(F.lit(f"Contains {what} ("), n.cast("string"), F.lit(" instances)"))))

    concrete = [shown(i, regex, what) for i, (regex, what) in enumerate(patterns)]
    return _kept(let(tx.phrases_found(text, phrases) if found is None else found, of_found), *concrete)


def explain_timing(seconds: Column | str) -> Column:
    column = F.col(seconds) if isinstance(seconds, str) else seconds
    shown = F.concat(tx.number_text(column), F.lit("s"))
    return F.array(
        F.when(column <= 0, F.lit("No timing data available"))
        .when(column < 10, F.concat(F.lit("Suspiciously fast response: "), shown,
                                    F.lit(" — possible copy-paste")))
        .when(column < 30, F.concat(F.lit("Very fast response: "), shown))
        .when(column < 60, F.concat(F.lit("Quick response: "), shown))
        .when(column < 300, F.concat(F.lit("Thoughtful response time: "), shown))
        .when(column < 600, F.concat(F.lit("Deliberate response time: "), shown))
        .otherwise(F.concat(F.lit("Slow response: "), shown,
                            F.lit(" — may indicate disengagement")))
    )


def explain_penalties(flags: Column | str) -> Column:
    return _kept(
        F.when(F.array_contains(flags, "MISSING_EMAIL"),
               F.lit("Major penalty: no email provided")),
        F.when(F.array_contains(flags, "ALL_MINIMAL_ANSWERS"),
               F.lit("All answers are minimal (≤5 words each)")),
    )


# --------------------------------------------------------------- forensics


def uniformity_signal(text: Column | str) -> Column:
    """``STRUCT<score, detail>``: how even the sentence lengths are (0.85, 0.5 or 0.1, and 0 for
    short texts), and the grade in words with their variation."""
    def verdict(score: float, *detail: Column) -> Column:
        return F.struct(_double(score).alias("score"), F.concat(*detail).alias("detail"))

    def graded(lengths: Column) -> Column:
        return F.when(F.size(lengths) < 3, verdict(0, F.lit(lx.FEW_SENTENCES))).otherwise(let(
            tx.coef_variation(lengths), lambda cv: let(tx.fixed(cv, 2), lambda shown: F.coalesce(*[
                F.when(cv < limit, verdict(score, F.lit(before), shown, F.lit(after)))
                for limit, score, before, after in lx.UNIFORMITY_GRADES]))))

    column = F.col(text) if isinstance(text, str) else text
    return F.when(tx.word_count(column) < 20, verdict(0, F.lit(lx.SHORT_FOR_UNIFORMITY))).otherwise(
        let(tx.sentence_lengths(column), graded))


def uniformity(text: Column | str) -> Column:
    """The score of ``uniformity_signal``."""
    return uniformity_signal(text)["score"]


def vocab_signal(text: Column | str, transitions=lx.AI_TRANSITIONS,
                 formal=lx.FORMAL_PATTERNS) -> Column:
    """``STRUCT<score, detail>``: the sum of the vocabulary signals that fired, at most 1, and 0
    for short texts; the detail lists them in their order."""
    column = F.col(text) if isinstance(text, str) else text

    def signal(fires: Column, weight: float, *name: Column) -> Column:
        return F.when(fires, F.struct(_double(weight).alias("weight"), F.concat(*name).alias("name")))

    def graded(lowered: Column, n: Column) -> Column:
        contractions = tx.regex_hits(lowered, lx.CONTRACTION_PATTERN) / F.greatest(n, F.lit(1))
        middling = let(F.when(n > 80, tx.hapax_ratio(lowered)), lambda h: signal(
            h.between(0.40, 0.55), 0.15, F.lit("hapax ratio in AI-typical range ("), tx.fixed(h, 2), F.lit(")")))
        stiff = let(tx.patterns_present(lowered, formal), lambda k: signal(
            k >= 2, 0.2, k.cast("string"), F.lit(" overly formal patterns")))
        listed = F.array(
            signal((n > 50) & (contractions < 0.01), 0.2, F.lit("no contractions")),
            *[signal(F.contains(lowered, F.lit(p)), 0.15, F.lit(f"AI-typical phrase: '{p}'")) for p in transitions],
            middling, stiff)
        return let(F.filter(listed, lambda s: s.isNotNull()), lambda fired: F.struct(
            F.least(F.lit(1.0), F.aggregate(fired, _double(0), lambda acc, s: acc + s["weight"])).alias("score"),
            F.when(F.size(fired) > 0, F.concat(F.lit("Vocabulary analysis: "), F.array_join(F.transform(
                fired, lambda s: s["name"]), ", "))).otherwise(F.lit(lx.NO_VOCABULARY_SIGNALS)).alias("detail")))

    short = F.struct(_double(0).alias("score"), F.lit(lx.SHORT_FOR_VOCABULARY).alias("detail"))
    return let(F.lower(F.coalesce(column, F.lit(""))),
               lambda t: let(tx.word_count(t), lambda n: F.when(n < 20, short).otherwise(graded(t, n))))


def vocab_signals(text: Column | str, transitions=lx.AI_TRANSITIONS,
                  formal=lx.FORMAL_PATTERNS) -> Column:
    """The score of ``vocab_signal``."""
    return vocab_signal(text, transitions, formal)["score"]


def ai_composite(uniform: Column | str, vocab: Column | str) -> Column:
    u = F.col(uniform) if isinstance(uniform, str) else uniform
    v = F.col(vocab) if isinstance(vocab, str) else vocab
    return u * 0.6 + v * 0.4


def ai_verdict(composite: Column | str) -> Column:
    c = F.col(composite) if isinstance(composite, str) else composite
    return (
        F.when(c > 0.65, F.lit("likely_ai")).when(c > 0.4, F.lit("suspicious"))
        .otherwise(F.lit("likely_human"))
    )


def timing_flag(seconds: Column | str, n_words: Column) -> Column:
    """``STRUCT<flag, severity>``; a null flag and severity 0 when nothing is odd."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    pasted = F.concat(F.lit("Response in "), tx.number_text(s), F.lit("s — likely copy-paste"))
    typed = F.concat(F.lit("Typed "), tx.fixed(n_words / s, 1),
                     F.lit(" words/sec — faster than average typing"))
    too_fast = (s > 0) & (s < 10)
    typed_fast = (s >= 10) & (s < 30) & (n_words / s > 5)
    return F.struct(
        F.when(too_fast, pasted).when(typed_fast, typed).alias("flag"),
        F.when(too_fast, 0.9).when(typed_fast, 0.6).otherwise(0.0).alias("severity"),
    )


def strikes_for(severity: Column) -> Column:
    return F.when(severity > 0.8, 2).otherwise(1)


# ------------------------------------------------------------------ replies


def classify_reply(text: Column | str, code_markers=lx.CODE_MARKERS,
                   vague_phrases=lx.VAGUE_PHRASES, tech_patterns=lx.TECH_PATTERNS) -> Column:
    """``STRUCT<response_type, confidence>``; the first rule that holds decides."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def verdict(kind: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("response_type"), F.lit(confidence).alias("confidence"))

    def decide(n: Column, lowered: Column) -> Column:
        has_code = tx.phrase_hits(column, code_markers) > 0
        asks = F.contains(column, F.lit("?")) & (n < 30)
        vague = tx.phrase_hits(lowered, vague_phrases)
        tech = tx.patterns_present(lowered, tech_patterns)
        ladder = let(tech, lambda k: (
            F.when(k >= 3, verdict("technical", 0.80))
            .when((vague >= 2) | ((n < 20) & (k == 0)), verdict("vague", 0.70))
            .when(k >= 1, verdict("technical", 0.60))
            .otherwise(verdict("vague", 0.50))
        ))
        return (
            F.when(n <= 3, verdict("minimal", 0.95))
            .when(has_code, verdict("code_submission", 0.85))
            .when(asks, verdict("question", 0.75))
            .otherwise(ladder)
        )

    return let(tx.word_count(column), lambda n: let(F.lower(column), lambda t: decide(n, t)))
