"""SQL fragments (DuckDB dialect) that restate the fixture adapters and rules."""

from __future__ import annotations

from sievework import fixtures as fx
from sievework import lexicons as lx


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(q(v) for v in values)


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def rnd(x: str, digits: int) -> str:
    """Correct rounding of the binary value, by way of its text."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


# ------------------------------------------------------------ text measures


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def wc(x: str) -> str:
    return f"len({words(x)})"


def share(x: str) -> str:
    w = words(f"lower({x})")
    return f"(CASE WHEN len({w}) > 0 THEN list_unique({w}) / len({w}) ELSE 0.0 END)"


def hapax(x: str) -> str:
    w = words(f"lower({x})")
    once = f"len(list_filter(map_values(list_histogram({w})), lambda n: n = 1))"
    return f"(CASE WHEN len({w}) > 0 THEN {once} / len({w}) ELSE 0.0 END)"


def sentence_lengths(x: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {wc('s')})"
    return f"list_filter({pieces}, lambda n: n > 0)"


def hits(x: str, regex: str) -> str:
    return f"len(regexp_extract_all({x}, {q(regex)}))"


def any_(x: str, regex: str, options: str = "") -> str:
    return f"regexp_matches({x}, {q(regex)}{', ' + q(options) if options else ''})"


def total(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def phrases(x: str, listed) -> str:
    return total([f"CAST(contains({x}, {q(p)}) AS INTEGER)" for p in dict.fromkeys(listed)])


def found(x: str, terms: str) -> str:
    return f"list_filter(list_distinct({terms}), lambda t: contains({x}, t))"


def below(x: str, steps, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {r}" for b, r in steps) + f" ELSE {otherwise} END"


CONTRACTIONS = r"[\p{L}\p{N}_]+'[\p{L}\p{N}_]+"
TOKENS = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"

# --------------------------------------------------------------- applicants


def na(x: str) -> str:
    return f"(CASE WHEN {x} IN ({items(lx.NA_TOKENS)}) OR {strip(x)} = 'nan' THEN NULL ELSE {x} END)"


WIDE = """w AS (SELECT doc_id AS row_id,
  CASE WHEN doc_id % 50 <> 49 THEN 'c' || doc_id END AS cid,
  CASE WHEN doc_id % 51 <> 0 THEN 'Doc   ' || doc_id || ' ' END AS name,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 40 = 23 THEN 'U' || (doc_id - 20) || '@x.test '
       WHEN doc_id % 40 = 27 THEN 'u' || (doc_id - 1) || '@x.test' ELSE 'u' || doc_id || '@x.test' END AS email,
  source AS role,
  CASE doc_id % 5 WHEN 1 THEN 'https://github.com/user' || doc_id WHEN 2 THEN 'https://github.com/test' || doc_id
       WHEN 3 THEN '  handle' || doc_id WHEN 4 THEN 'http://GitHub.com/user' || doc_id || '/' END AS github,
  CASE WHEN doc_id % 3 <> 0 THEN 'person' || doc_id END AS linkedin,
  string_split(text, chr(10)) AS parts,
  CASE WHEN doc_id % 90 = 89 THEN 'n/a?' WHEN doc_id % 90 = 88 THEN 'NA'
       ELSE CAST(doc_id * 7 % 900 AS VARCHAR) END AS time_taken
  FROM documents)"""

RESOLVED = f"""r AS (SELECT row_id, {na('cid')} AS cid, {na('name')} AS name, {na('email')} AS email,
  {na('role')} AS role, {na('github')} AS github, {na('linkedin')} AS linkedin, {na('time_taken')} AS time_taken,
  {strip(f"coalesce({na('parts[1]')}, '')")} AS a1, {strip(f"coalesce({na('parts[2]')}, '')")} AS a2,
  {strip(f"coalesce({na('array_to_string(parts[3:], chr(10))')}, '')")} AS a3 FROM w)"""


def _canonical(source: str, name: str) -> str:
    return f"""{name} AS (SELECT row_id, coalesce(nullif({strip('cid')}, ''), 'auto_' || row_id) AS candidate_id,
  array_to_string({words("coalesce(name, '')")}, ' ') AS name,
  CASE WHEN contains(email, '@') THEN lower({strip('email')}) ELSE '' END AS email,
  {strip("coalesce(role, '')")} AS role,
  CASE WHEN {strip('github')} = '' THEN NULL
       WHEN contains(lower({strip('github')}), 'github.com') OR starts_with({strip('github')}, 'http') THEN {strip('github')}
       ELSE 'https://github.com/' || {strip('github')} END AS github_url,
  CASE WHEN {strip('linkedin')} = '' THEN NULL
       WHEN contains(lower({strip('linkedin')}), 'linkedin.com') OR starts_with({strip('linkedin')}, 'http') THEN {strip('linkedin')}
       ELSE 'https://linkedin.com/in/' || {strip('linkedin')} END AS linkedin_url,
  CASE WHEN time_taken IS NULL THEN CAST('nan' AS DOUBLE)
       ELSE coalesce(TRY_CAST({strip('time_taken')} AS DOUBLE), 0.0) END AS seconds,
  a1, a2, a3, lower(a1 || ' ' || a2 || ' ' || a3) AS all_text,
  array_to_string(list_filter([a1, a2, a3], lambda a: a <> ''), ' ') AS raw_text
  FROM {source})"""


CANONICAL = _canonical("r", "c")
BASE = [WIDE, RESOLVED, CANONICAL]

BAD = "(NOT contains(coalesce(email, ''), '@') AND " + strip("coalesce(name, '')") + " = '')"
KEY = (f"(coalesce(nullif(lower({strip('email')}), ''), 'nan') || '|' || lower(coalesce({strip('role')}, 'nan')))")
KEYED = f"k AS (SELECT *, {KEY} AS key, {BAD} AS bad FROM r)"
JUDGED = f"""j AS (SELECT *, CASE WHEN bad THEN 'no_identity' WHEN row_id <> first_row THEN 'duplicate' END AS reject_reason
  FROM (SELECT *, min(CASE WHEN NOT bad THEN row_id END) OVER (PARTITION BY key) AS first_row FROM k))"""
KEPT = [WIDE, RESOLVED, KEYED, JUDGED, _canonical("(SELECT * FROM j WHERE reject_reason IS NULL)", "c")]

# ------------------------------------------------------------------ scoring


def role_terms(role: str = "role") -> str:
    key = f"replace(lower({role}), ' ', '_')"
    branches = " ".join(
        f"WHEN {q(name)} THEN [{items(terms)}]" for name, terms in fx.ROLE_TERMS.items()
        if name != lx.DEFAULT_ROLE)
    return f"(CASE {key} {branches} ELSE [{items(fx.ROLE_TERMS[lx.DEFAULT_ROLE])}] END)"


def answer_points(a: str) -> str:
    n = wc(a)
    ladder = "CASE " + " ".join(f"WHEN {n} <= {b} THEN {p}" for b, p in lx.LENGTH_LADDER) + f" ELSE {lx.LENGTH_TOP} END"
    variety = f"CASE WHEN {share(a)} > 0.7 THEN 10 WHEN {share(a)} < 0.4 THEN -10 ELSE 0 END"
    bonus = total([f"CASE WHEN {any_(a, r, 'i')} THEN {b * lx.QUALITY_FACTOR} ELSE 0.0 END"
                   for r, b in fx.QUALITY_RULES])
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE CAST(({ladder}) + ({variety}) AS DOUBLE) + {bonus} END)"


def clamp(x: str) -> str:
    return f"least(100.0, greatest(0.0, {x}))"


TECHNICAL = (f"(CASE WHEN {strip('all_text')} = '' THEN 0.0 ELSE CAST(least(100, (CASE "
             + " ".join(f"WHEN n_found >= {b} THEN {p}" for b, p in lx.TERM_LADDER)
             + f" ELSE {lx.TERM_FLOOR} END) + 2 * {hits('all_text', lx.VERSION_PATTERN)}) AS DOUBLE) END)")
QUALITY = clamp(f"({answer_points('a1')} + {answer_points('a2')} + {answer_points('a3')}) / 3")
FAKE = phrases("list_extract(string_split(lower(github_url), '/'), -1)", lx.FAKE_HANDLE_TOKENS) + " > 0"
CREDIBILITY = clamp(
    f"CAST(50 + (CASE WHEN coalesce(github_url, '') = '' THEN -10 WHEN {FAKE} THEN -20 "
    f"WHEN {phrases('all_text', fx.WORK_REFERENCES)} > 0 THEN 30 ELSE 20 END) "
    "+ (CASE WHEN coalesce(linkedin_url, '') = '' THEN -5 ELSE 15 END) AS DOUBLE)")
SPECIFICITY = clamp(
    "CAST(60 + " + total([f"least(15, 5 * {hits('all_text', r)})" for r, _ in fx.PATTERNS])
    + f" - 8 * {phrases('all_text', fx.PHRASES)} AS DOUBLE)")


def timing(x: str) -> str:
    return (f"CAST(CASE WHEN isnan({x}) THEN 50 WHEN {x} <= 0 THEN 50 ELSE "
            f"{below(x, lx.TIMING_LADDER, 50)} END AS DOUBLE)")


MINIMAL = f"({wc('a1')} <= 5 AND {wc('a2')} <= 5 AND {wc('a3')} <= 5)"
WEIGHTED = " + ".join(f"{d} * {lx.WEIGHTS[d]}" for d in lx.DIMENSIONS)


def tier(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN {q(t)}" for b, t in lx.TIER_LADDER) + " ELSE 'Reject' END"


DIMENSIONS = f"""d AS (SELECT *, CAST({TECHNICAL} AS DOUBLE) AS technical_relevance,
  CAST({QUALITY} AS DOUBLE) AS answer_quality, CAST({CREDIBILITY} AS DOUBLE) AS profile_credibility,
  CAST({SPECIFICITY} AS DOUBLE) AS specificity, {timing('seconds')} AS timing
  FROM (SELECT *, len({found('all_text', role_terms())}) AS n_found FROM c))"""
SCORED = f"""s AS (SELECT *, {tier('raw_total')} AS tier, {rnd('raw_total', 2)} AS total_score,
  array_to_string(list_filter([CASE WHEN email = '' THEN 'MISSING_EMAIL' END,
    CASE WHEN minimal THEN 'ALL_MINIMAL_ANSWERS' END], lambda f: f IS NOT NULL), ',') AS flags,
  CAST(email = '' AS INTEGER) + CAST(minimal AS INTEGER) AS n_flags
  FROM (SELECT *, weighted * (CASE WHEN email = '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN minimal THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) AS raw_total
    FROM (SELECT *, CAST({WEIGHTED} AS DOUBLE) AS weighted, {MINIMAL} AS minimal FROM d)))"""
SCORES = BASE + [DIMENSIONS, SCORED]

# ---------------------------------------------------------------- forensics


def uniformity(x: str) -> str:
    n = sentence_lengths(x)
    cv = f"list_aggregate({n}, 'stddev_pop') / list_avg({n})"
    return (f"CAST(CASE WHEN {wc(x)} < 20 THEN 0.0 WHEN len({n}) < 3 THEN 0.0 WHEN {cv} < 0.2 THEN 0.85 "
            f"WHEN {cv} < 0.35 THEN 0.5 ELSE 0.1 END AS DOUBLE)")


def vocab(x: str) -> str:
    t, n = f"lower({x})", wc(x)
    parts = [f"(CASE WHEN {n} > 50 AND {hits(t, CONTRACTIONS)} / greatest({n}, 1) < 0.01 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"]
    parts += [f"(CASE WHEN contains({t}, {q(p)}) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)" for p in fx.TRANSITIONS]
    parts.append(f"(CASE WHEN {n} > 80 AND {hapax(x)} BETWEEN 0.40 AND 0.55 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)")
    formal = total([f"CAST({any_(t, p)} AS INTEGER)" for p in fx.FORMAL])
    parts.append(f"(CASE WHEN {formal} >= 2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)")
    return f"(CASE WHEN {n} < 20 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {' + '.join(parts)}) END)"


def uniformity_detail(x: str) -> str:
    n = sentence_lengths(x)
    cv = f"list_aggregate({n}, 'stddev_pop') / list_avg({n})"
    grades = " ".join(f"WHEN {cv} < {'1e300' if limit > 1 else limit} THEN {q(before)} || format('{{:.2f}}', {cv}) || {q(after)}"
                      for limit, _, before, after in lx.UNIFORMITY_GRADES)
    return (f"CASE WHEN {wc(x)} < 20 THEN {q(lx.SHORT_FOR_UNIFORMITY)} WHEN len({n}) < 3 THEN {q(lx.FEW_SENTENCES)} {grades} END")


def vocab_detail(x: str) -> str:
    t, n = f"lower({x})", wc(x)
    formal = total([f"CAST({any_(t, p)} AS INTEGER)" for p in fx.FORMAL])
    parts = [f"CASE WHEN {n} > 50 AND {hits(t, CONTRACTIONS)} / greatest({n}, 1) < 0.01 THEN 'no contractions' END"]
    parts += [f"CASE WHEN contains({t}, {q(p)}) THEN {q(f"AI-typical phrase: '{p}'")} END" for p in fx.TRANSITIONS]
    parts.append(f"CASE WHEN {n} > 80 AND {hapax(x)} BETWEEN 0.40 AND 0.55 THEN 'hapax ratio in AI-typical range (' "
                 f"|| format('{{:.2f}}', {hapax(x)}) || ')' END")
    parts.append(f"CASE WHEN {formal} >= 2 THEN {formal} || ' overly formal patterns' END")
    fired = f"list_filter([{', '.join(parts)}], lambda s: s IS NOT NULL)"
    return (f"CASE WHEN {n} < 20 THEN {q(lx.SHORT_FOR_VOCABULARY)} WHEN len({fired}) = 0 THEN {q(lx.NO_VOCABULARY_SIGNALS)} "
            f"ELSE 'Vocabulary analysis: ' || array_to_string({fired}, ', ') END")


def signals(source: str, text: str, name: str = "g") -> str:
    return f"""{name} AS (SELECT *, {rnd('composite', 3)} AS ai_probability,
  CASE WHEN composite > 0.65 THEN 'likely_ai' WHEN composite > 0.4 THEN 'suspicious' ELSE 'likely_human' END AS verdict
  FROM (SELECT *, uniformity * 0.6::DOUBLE + vocab * 0.4::DOUBLE AS composite
    FROM (SELECT *, {uniformity(text)} AS uniformity, {vocab(text)} AS vocab FROM {source})))"""


def number_text(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN 'nan' ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' END)"


TOTAL_WORDS = f"({wc('a1')} + {wc('a2')} + {wc('a3')})"
_PASTED = "(NOT isnan(seconds) AND seconds > 0 AND seconds < 10)"
_TYPED = f"(NOT isnan(seconds) AND seconds >= 10 AND seconds < 30 AND {TOTAL_WORDS} / seconds > 5)"
FLAGGED = f"""f AS (SELECT *, CASE WHEN {_PASTED} THEN 'paste' WHEN {_TYPED} THEN 'typed' END AS flag_kind,
  CAST(CASE WHEN {_PASTED} THEN 0.9 WHEN {_TYPED} THEN 0.6 ELSE 0.0 END AS DOUBLE) AS severity FROM c)"""

# --------------------------------------------------------------- similarity


def tfidf(source: str, stop=(), features: int | None = lx.MAX_FEATURES) -> list[str]:
    """CTEs ending in ``v(question_id, row_id, term, weight)`` for a source of answers."""
    stop_test = f"AND term NOT IN ({items(stop)})" if stop else ""
    return [
        f"src AS ({source})",
        f"answered AS (SELECT * FROM src WHERE {strip('answer_text')} <> '')",
        f"""tf AS (SELECT question_id, row_id, term, count(*) AS tf FROM (SELECT question_id, row_id,
  unnest(regexp_extract_all(lower(answer_text), {q(TOKENS)})) AS term FROM answered)
  WHERE true {stop_test} GROUP BY ALL)""",
        f"""df AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY freq DESC, term) AS rk
  FROM (SELECT question_id, term, count(*) AS df, sum(tf) AS freq FROM tf GROUP BY ALL)) WHERE {'true' if features is None else f'rk <= {features}'})""",
        "sizes AS (SELECT question_id, count(*) AS n FROM answered GROUP BY ALL)",
        """wt AS (SELECT question_id, row_id, term, tf * (ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1) AS w
  FROM tf JOIN df USING (question_id, term) JOIN sizes USING (question_id))""",
        """v AS (SELECT question_id, row_id, term,
  w / sqrt(sum(w * w) OVER (PARTITION BY question_id, row_id)) AS weight FROM wt)""",
    ]


def pairs(threshold: float) -> list[str]:
    """CTE ``p`` of similar pairs with both ends' candidate and text, after ``tfidf``."""
    return [
        f"""sim AS (SELECT a.question_id, a.row_id AS ra, b.row_id AS rb, sum(a.weight * b.weight) AS cosine
  FROM v a JOIN v b ON a.question_id = b.question_id AND a.term = b.term AND a.row_id < b.row_id
  GROUP BY ALL HAVING sum(a.weight * b.weight) >= {threshold - 1e-9!r}::DOUBLE)""",
        f"""p AS (SELECT sim.question_id, ra AS row_a, rb AS row_b, x.candidate_id AS candidate_a, x.name AS candidate_a_name,
  y.candidate_id AS candidate_b, y.name AS candidate_b_name, {rnd('cosine', 4)} AS similarity,
  CASE WHEN cosine >= 0.92 THEN 'high' ELSE 'medium' END AS severity,
  x.answer_text AS text_a, y.answer_text AS text_b
  FROM sim JOIN src x ON x.question_id = sim.question_id AND x.row_id = ra
  JOIN src y ON y.question_id = sim.question_id AND y.row_id = rb
  WHERE x.candidate_id <> y.candidate_id)""",
    ]


DOCUMENT_ANSWERS = ("SELECT lang AS question_id, doc_id AS row_id, CASE WHEN doc_id % 50 <> 49 THEN 'c' ELSE 'auto_' END || doc_id AS candidate_id, "
                    "'Doc ' || doc_id AS name, text AS answer_text FROM documents")
FLAT_ANSWERS = " UNION ALL ".join(
    f"SELECT 'q{i}' AS question_id, row_id, candidate_id, name, a{i} AS answer_text FROM c" for i in (1, 2, 3))

# ------------------------------------------------------------------ replies

REPLIES = """rep AS (SELECT 't' || conv_id AS thread_id, turn AS seq,
  1704067200000000 + turn * 3600000000 AS received_us, text AS body, CAST(turn % 4 AS INTEGER) AS round
  FROM conversations WHERE role = 'user')"""
REPLY_THREADS = """thr AS (SELECT 't' || conv_id AS thread_id, 'c' || conv_id AS candidate_id,
  'Conv ' || conv_id AS name, 'u' || conv_id || '@x.test' AS email, 'Engineer' AS role,
  CAST(conv_id % 3 + 1 AS INTEGER) AS round FROM (SELECT DISTINCT conv_id FROM conversations))"""


def classified(source: str, text: str = "body", name: str = "cl") -> str:
    low = f"lower({text})"
    vague = phrases(low, fx.VAGUE_PHRASES)
    tech = total([f"CAST({any_(low, p)} AS INTEGER)" for p in fx.TECH_PATTERNS])
    code = phrases(text, fx.CODE_MARKERS)
    return f"""{name} AS (SELECT * EXCLUDE (n, tech, vague), CASE WHEN n <= 3 THEN 'minimal' WHEN {code} > 0 THEN 'code_submission'
    WHEN contains({text}, '?') AND n < 30 THEN 'question' WHEN tech >= 3 THEN 'technical'
    WHEN vague >= 2 OR (n < 20 AND tech = 0) THEN 'vague' WHEN tech >= 1 THEN 'technical' ELSE 'vague' END AS response_type,
  CAST(CASE WHEN n <= 3 THEN 0.95 WHEN {code} > 0 THEN 0.85 WHEN contains({text}, '?') AND n < 30 THEN 0.75
    WHEN tech >= 3 THEN 0.80 WHEN vague >= 2 OR (n < 20 AND tech = 0) THEN 0.70
    WHEN tech >= 1 THEN 0.60 ELSE 0.50 END AS DOUBLE) AS confidence
  FROM (SELECT *, {wc(text)} AS n, {tech} AS tech, {vague} AS vague FROM {source}))"""


DECISIONS = ("dt AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {q(a)}, {q(tpl)}, {str(adv).lower()}, {q(desc)})" for t, a, tpl, adv, desc in lx.DECISIONS)
    + ") AS x(response_type, d_action, d_template, d_advance, d_description))")


def decided(source: str, name: str = "nx", max_rounds: int = lx.MAX_ROUNDS) -> str:
    done = f"round >= {max_rounds}"
    return f"""{name} AS (SELECT t.*, CASE WHEN {done} THEN 'complete' ELSE d_action END AS action,
  CASE WHEN {done} THEN NULL ELSE d_template END AS template, NOT ({done}) AND d_advance AS advance_round,
  CASE WHEN {done} THEN 'Max rounds reached' ELSE d_description END AS description
  FROM {source} t LEFT JOIN dt USING (response_type))"""


QUESTIONS = ("qs AS (SELECT * FROM (VALUES " + ", ".join(
    f"({r}, {q(text)})" for r, text in lx.QUESTIONS.items()) + ") AS x(q_round, q_text))")

# ------------------------------------------------------------------ threads

EVENTS = """ev AS (SELECT 't' || user_id AS thread_id, 'c' || user_id AS candidate_id, epoch_us(ts) AS us,
  event_id AS seq, event_type AS event,
  CASE event_type WHEN 'view' THEN 'follow_up_sent' WHEN 'click' THEN 'replied' WHEN 'purchase' THEN 'completed'
    ELSE 'awaiting_reply' END AS to_state, event_type = 'view' AS advance_round FROM events)"""
THREADS = """th AS (SELECT thread_id, arg_max(to_state, us::HUGEINT * 100000000 + seq) AS state,
  1 + count(*) FILTER (WHERE advance_round) AS round, min(us) AS created_us, max(us) AS last_us,
  count(*) AS n_events FROM ev GROUP BY ALL)"""
GAPS = """gp AS (SELECT event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (
  PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE, CAST('nan' AS DOUBLE)) AS seconds FROM events)"""
