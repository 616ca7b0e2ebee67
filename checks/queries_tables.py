"""Queries on sources, sinks, reshaping, normalising and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.queries_threads import PROCESSED
from checks.registry import ORACLES, query
from sievework import fixtures as fx
from sievework import lexicons as lx
from sievework.functions import text as tx
from sievework.operators import keyed
from sievework.session import new_path, stage
from sievework.sources import applicants as ap
from sievework.sources import tables as tb

QUESTION_COLUMNS = ["q1_first_line", "q2_second_line", "q3"]


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def _as_file(spark, folder: str) -> str:
    """The wide applicants written out as CSV by all tasks, with their own row number."""
    path = new_path(spark, "applicants-csv")
    fx.applicants_wide(spark, folder).withColumnRenamed("row_id", "row_no").write.option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("scan_csv", S.with_([S.WIDE], """SELECT coalesce(cid, '') AS applicant_id, coalesce(name, '') AS full_name,
  coalesce(email, '') AS email, coalesce(github, '') AS github, md5(coalesce(parts[1], '')) AS q1,
  md5(coalesce(parts[2], '')) AS q2, md5(array_to_string(parts[3:], chr(10))) AS q3, time_taken FROM w"""))
def scan_csv(spark, d):
    raw = ap.scan_csv(spark, _as_file(spark, d))
    return raw.select(
        _text("Applicant_ID").alias("applicant_id"), _text(" full_name").alias("full_name"),
        _text("email").alias("email"), _text("github").alias("github"),
        F.md5(_text("q1_first_line")).alias("q1"), F.md5(_text("q2_second_line")).alias("q2"),
        F.md5(_text("q3")).alias("q3"), "time_taken")


def _mixed_files(spark, folder: str) -> str:
    """The same in files with two column orders, and files with a broken line for every document."""
    path = new_path(spark, "applicants-mixed")
    wide = fx.applicants_wide(spark, folder).withColumnRenamed("row_id", "row_no")
    for rest, names in ((0, wide.columns), (1, wide.columns[::-1])):
        wide.filter(F.col("row_no") % 2 == rest).select(*[F.col(f"`{n}`") for n in names]).write.mode("append").option(
            "header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    # Lines with more values than their header: the one column holds them whole, commas included.
    broken = F.concat(F.lit("b"), "doc_id", F.lit(",x,too,many"))
    fx.table(spark, folder, "documents").select(broken.alias("Applicant_ID,email")).write.mode("append").option(
        "header", True).option("sep", "\t").csv(path)
    return path


@query("scan_csv_mixed", S.with_([S.WIDE], """SELECT coalesce(cid, '') AS applicant_id, coalesce(email, '') AS email,
  coalesce(github, '') AS github, md5(coalesce(parts[1], '')) AS q1, md5(array_to_string(parts[3:], chr(10))) AS q3 FROM w"""))
def scan_csv_mixed(spark, d):
    raw = ap.scan_csv(spark, _mixed_files(spark, d))
    return raw.filter(F.col(ap.CORRUPT).isNull()).select(
        _text("Applicant_ID").alias("applicant_id"), _text("email").alias("email"), _text("github").alias("github"),
        F.md5(_text("q1_first_line")).alias("q1"), F.md5(_text("q3")).alias("q3"))


@query("parse_errors", "SELECT 'b' || doc_id || ',x,too,many' AS line, 'parse_error' AS reject_reason FROM documents")
def parse_errors(spark, d):
    return ap.parse_errors(ap.scan_csv(spark, _mixed_files(spark, d))).drop("row_id")


@query("read_applicants", S.with_(S.KEPT, """SELECT candidate_id, name, email, role, github_url, linkedin_url,
  CASE WHEN isnan(seconds) THEN -1.0 ELSE seconds END AS seconds, md5(a1) AS a1, md5(a2) AS a2, md5(a3) AS a3 FROM c"""))
def read_applicants(spark, d):
    raw = ap.scan_csv(spark, _as_file(spark, d), with_row_id=False).withColumn(
        "row_id", F.col("row_no").cast("bigint"))
    c = ap.clean_applicants(raw)
    return c.select("candidate_id", "name", "email", "role", "github_url", "linkedin_url",
                    F.when(F.isnan("response_time_seconds"), -1.0)
                    .otherwise(F.col("response_time_seconds")).alias("seconds"),
                    *[F.md5(F.col("answers")[i]["answer_text"]).alias(f"a{i + 1}") for i in range(3)])


@query("na_strings", S.with_([S.WIDE], f"""SELECT row_id, {S.na('email')} AS email, {S.na('time_taken')} AS time_taken,
  {S.na('github')} AS github FROM w"""))
def na_strings(spark, d):
    w = fx.applicants_wide(spark, d)
    return w.select("row_id", *[ap.na_to_null(c).alias(c) for c in ("email", "time_taken", "github")])


@query("resolve_columns", S.with_([S.WIDE, S.RESOLVED], """SELECT row_id, cid AS candidate_id, name, email, role,
  github AS github_url, linkedin AS linkedin_url, time_taken AS response_time_seconds,
  md5(a1 || '|' || a2 || '|' || a3) AS answers FROM r"""))
def resolve_columns(spark, d):
    r = fx.applicants(spark, d)
    body = F.array_join(F.transform("answers", lambda a: a["answer_text"]), "|")
    return r.withColumn("answers", F.md5(body))


@query("find_question_cols", S.with_([S.WIDE], """SELECT h AS header, count(*) AS n_rows,
  count(*) FILTER (WHERE t <> '') AS n_filled FROM (
  SELECT 'q1_first_line' AS h, coalesce(parts[1], '') AS t FROM w UNION ALL
  SELECT 'q2_second_line', coalesce(parts[2], '') FROM w UNION ALL
  SELECT 'q3', array_to_string(parts[3:], chr(10)) FROM w) GROUP BY h"""))
def find_question_cols(spark, d):
    w = fx.applicants_wide(spark, d)
    long = w.unpivot(["row_id"], ap.find_question_cols(w.columns), "header", "t")
    return long.groupBy("header").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_text("t") != "").alias("n_filled"))


@query("unpivot_answers", S.with_(S.BASE[:2], """SELECT row_id, 'q1' AS question_id, 'First line?' AS question_text, md5(a1) AS answer FROM r
  UNION ALL SELECT row_id, 'q2', 'Second line?', md5(a2) FROM r UNION ALL SELECT row_id, 'q3', 'q3', md5(a3) FROM r"""))
def unpivot_answers(spark, d):
    long = ap.unpivot_answers(fx.applicants_wide(spark, d), ["row_id"])
    return long.select("row_id", "question_id", "question_text", F.md5("answer_text").alias("answer"))


@query("flatten_answers", S.with_(S.BASE, " UNION ALL ".join(
    f"SELECT candidate_id, {i - 1} AS pos, 'q{i}' AS question_id, md5(a{i}) AS answer FROM c" for i in (1, 2, 3))))
def flatten_answers(spark, d):
    flat = ap.flatten_answers(fx.candidates(spark, d))
    return flat.select("candidate_id", "pos", "question_id", F.md5("answer_text").alias("answer"))


@query("nest_answers", S.with_(S.BASE, """SELECT candidate_id, 'q1,q2,q3' AS questions,
  md5(a1 || '|' || a2 || '|' || a3) AS answers FROM c"""))
def nest_answers(spark, d):
    nested = ap.nest_answers(ap.flatten_answers(fx.candidates(spark, d)))
    return nested.select(
        "candidate_id",
        F.array_join(F.transform("answers", lambda a: a["question_id"]), ",").alias("questions"),
        F.md5(F.array_join(F.transform("answers", lambda a: a["answer_text"]), "|")).alias("answers"))


@query("valid_rows", S.with_(S.KEPT[:3], "SELECT row_id, cid AS candidate_id FROM k WHERE NOT bad"))
def valid_rows(spark, d):
    return ap.valid_rows(fx.applicants(spark, d)).select("row_id", "candidate_id")


@query("rejected_rows", S.with_(S.KEPT[:4], f"""SELECT j.row_id, j.reject_reason,
  CASE WHEN j.reject_reason = 'duplicate' THEN coalesce(f.cid, 'auto_' || f.row_id) END AS duplicate_of
  FROM j LEFT JOIN j f ON f.row_id = j.first_row WHERE j.reject_reason IS NOT NULL"""))
def rejected_rows(spark, d):
    return ap.rejected_rows(fx.applicants(spark, d)).select("row_id", "reject_reason", "duplicate_of")


@query("ingest_counts", S.with_(S.KEPT[:4], """SELECT count(*) AS rows_read,
  count(*) FILTER (WHERE reject_reason IS NULL) AS kept,
  count(*) FILTER (WHERE reject_reason = 'duplicate') AS duplicates,
  count(*) FILTER (WHERE reject_reason = 'no_identity') AS no_identity FROM j"""))
def ingest_counts(spark, d):
    return ap.ingest_counts(fx.applicants(spark, d))


_SECOND = """second AS (SELECT row_id FROM c WHERE coalesce(nullif(email, ''), name) <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(coalesce(nullif(email, ''), name)) ORDER BY row_id) = 1)"""


def _numbered_scan(spark, d):
    """The mixed files, numbered by the row each line was made from; broken lines by none."""
    return ap.scan_csv(spark, _mixed_files(spark, d), with_row_id=False).withColumn("row_id", F.col("row_no").cast("bigint"))


@query("reject_table", S.with_(S.KEPT + [_SECOND], """SELECT j.row_id, j.reject_reason,
  CASE WHEN j.reject_reason = 'duplicate' THEN coalesce(f.cid, 'auto_' || f.row_id) END AS duplicate_of, CAST(NULL AS VARCHAR) AS line
  FROM j LEFT JOIN j f ON f.row_id = j.first_row WHERE j.reject_reason IS NOT NULL
  UNION ALL SELECT row_id, 'same_identity', NULL, NULL FROM c WHERE row_id NOT IN (SELECT row_id FROM second)
  UNION ALL SELECT NULL, 'parse_error', NULL, 'b' || doc_id || ',x,too,many' FROM documents"""))
def reject_table(spark, d):
    return ap.reject_table(stage(_numbered_scan(spark, d), "scan"))


@query("ingest_run", S.with_(S.KEPT + [_SECOND], """SELECT 'documents' AS source, 'partial' AS status,
  (SELECT 2 * count(*) FROM documents) AS rows_read, (SELECT count(*) FROM second) AS kept,
  (SELECT count(*) FROM documents) AS parse_errors, count(*) FILTER (WHERE reject_reason = 'no_identity') AS no_identity,
  count(*) FILTER (WHERE reject_reason = 'duplicate') AS duplicates,
  (SELECT count(*) FROM c) - (SELECT count(*) FROM second) AS same_identity,
  (SELECT count(*) FROM second) AS stored, (SELECT count(*) FROM second) AS logged FROM j"""))
def ingest_run(spark, d):
    folder, at = new_path(spark, "ingested"), F.lit("2024-01-01").cast("timestamp")
    run = ap.run_ingestion(_numbered_scan(spark, d), folder, "documents", at)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return run.withColumns({"stored": count(tb.read_upserted(spark, f"{folder}/candidates")),
                            "logged": count(tb.read_table(spark, f"{folder}/interactions"))})


@query("norm_email", S.with_(S.BASE, "SELECT row_id, email FROM c"))
def norm_email(spark, d):
    return fx.applicants(spark, d).select("row_id", ap.norm_email("email").alias("email"))


@query("norm_name", S.with_(S.BASE, "SELECT row_id, name FROM c"))
def norm_name(spark, d):
    return fx.applicants(spark, d).select("row_id", ap.norm_name("name").alias("name"))


@query("norm_profile_url", S.with_(S.BASE, "SELECT row_id, github_url, linkedin_url FROM c"))
def norm_profile_url(spark, d):
    return fx.applicants(spark, d).select(
        "row_id", ap.norm_github("github_url").alias("github_url"),
        ap.norm_linkedin("linkedin_url").alias("linkedin_url"))


@query("fill_ids", S.with_(S.BASE, "SELECT row_id, candidate_id FROM c"))
def fill_ids(spark, d):
    return fx.applicants(spark, d).select("row_id", ap.fill_ids("candidate_id").alias("candidate_id"))


@query("lenient_number", S.with_(S.BASE, """SELECT row_id, isnan(seconds) AS missing,
  CASE WHEN isnan(seconds) THEN 0.0::DOUBLE ELSE seconds END AS seconds FROM c"""))
def lenient_number(spark, d):
    s = fx.applicants(spark, d).select(
        "row_id", ap.lenient_number("response_time_seconds").alias("s"))
    return s.select("row_id", F.isnan("s").alias("missing"),
                    F.when(F.isnan("s"), 0.0).otherwise(F.col("s")).alias("seconds"))


@query("dedup_first", S.with_(S.KEPT[:3], "SELECT min(row_id) AS row_id FROM k GROUP BY key"))
def dedup_first(spark, d):
    return ap.dedup_first(fx.applicants(spark, d)).select("row_id")


@query("dedup_identity", S.with_(S.BASE, """SELECT min(row_id) AS row_id FROM c
  WHERE coalesce(nullif(email, ''), name) <> '' GROUP BY lower(coalesce(nullif(email, ''), name))"""))
def dedup_identity(spark, d):
    return ap.dedup_identity(fx.candidates(spark, d)).select("row_id")


@query("first_per_key", """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_per_key(spark, d):
    firsts = keyed.first_per_key(fx.table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")
    return firsts.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("latest_per_key", """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark, d):
    latest = keyed.latest_per_key(fx.table(spark, d, "orders"), ["o_custkey", "o_orderpriority"],
                                  ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


def _orders_as_candidates(spark, d):
    """Orders as applications: the customer is the email, the priority the role."""
    return fx.table(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("candidate_id"), F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("u"), "o_custkey").alias("email"), F.col("o_orderpriority").alias("role"),
        F.col("o_totalprice").alias("value"), (F.col("o_orderdate") >= "1995-01-01").alias("late"))


@query("upsert_candidates", """WITH o AS (SELECT 'o' || o_orderkey AS candidate_id, o_orderkey AS row_id, 'u' || o_custkey AS email,
  o_orderpriority AS role, o_totalprice AS value, o_orderdate >= TIMESTAMP '1995-01-01' AS late FROM orders),
  old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email, role ORDER BY row_id) AS rn FROM o WHERE NOT late) WHERE rn = 1),
  new AS (SELECT email, role, arg_max(value, row_id) AS value, max(row_id) AS row_id, arg_min(candidate_id, row_id) AS cid FROM o WHERE late GROUP BY ALL)
  SELECT email, role, coalesce(old.candidate_id, new.cid) AS candidate_id, coalesce(new.row_id, old.row_id) AS row_id,
  coalesce(new.value, old.value) AS value FROM old FULL JOIN new USING (email, role)""")
def upsert_candidates(spark, d):
    o = _orders_as_candidates(spark, d)
    old = keyed.first_per_key(o.filter(~F.col("late")).drop("late"), ["email", "role"])
    return tb.upsert_candidates(old, o.filter("late").drop("late"))


@query("upsert_into", ORACLES["upsert_candidates"])
def upsert_into(spark, d):
    # The same in a stored table: the first orders are written, the late ones merged in place.
    path, o = new_path(spark, "upserted"), _orders_as_candidates(spark, d)
    tb.upsert_into(keyed.first_per_key(o.filter(~F.col("late")).drop("late"), ["email", "role"]), path)
    tb.upsert_into(o.filter("late").drop("late"), path)
    return tb.read_upserted(spark, path)


@query("append_answers", S.with_(S.BASE, " UNION ALL ".join(
    f"SELECT candidate_id, 'q{i}' AS question_id, 1 AS run, md5(a{i}) AS answer FROM c" for i in (1, 2, 3))))
def append_answers(spark, d):
    # Two runs append the same answers; reading keeps the later write of each.
    path = new_path(spark, "answers")
    flat = ap.flatten_answers(fx.candidates(spark, d)).select(
        "candidate_id", "question_id", F.md5("answer_text").alias("answer"))
    for run in (0, 1):
        tb.append(flat.withColumn("run", F.lit(run)), path)
    return tb.latest_answers(tb.read_table(spark, path), ["run"]).select(
        "candidate_id", "question_id", "run", "answer")


@query("replace_scores", """SELECT 'u' || o_custkey AS candidate_id, epoch_us(o_orderdate) AS scored_us, max(o_totalprice) AS total_score
  FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders) WHERE o_orderdate = last GROUP BY ALL""")
def replace_scores(spark, d):
    scores = fx.table(spark, d, "orders").select(
        F.concat(F.lit("u"), "o_custkey").alias("candidate_id"),
        F.col("o_orderdate").cast("timestamp").alias("scored_at"),
        F.col("o_totalprice").alias("total_score"), F.col("o_orderdate") < "1995-01-01")
    early = scores.columns[-1]
    merged = tb.replace_scores(scores.filter(F.col(f"`{early}`")).drop(early),
                               scores.filter(~F.col(f"`{early}`")).drop(early))
    return merged.select("candidate_id", F.unix_micros("scored_at").alias("scored_us"), "total_score")


@query("append_flags", S.with_(S.BASE + [S.FLAGGED], """SELECT candidate_id, 'timing' AS flag_type, severity, 2 AS n FROM f WHERE flag_kind IS NOT NULL"""))
def append_flags(spark, d):
    from sievework.operators.forensics import timing_flags

    path = new_path(spark, "flags")
    flags = timing_flags(fx.candidates(spark, d)).filter(F.col("flag").isNotNull()).select(
        "candidate_id", F.lit("timing").alias("flag_type"), "severity")
    tb.append(flags, path)
    tb.append(flags, path)
    return tb.read_table(spark, path).groupBy("candidate_id", "flag_type", "severity").agg(
        F.count(F.lit(1)).cast("int").alias("n"))


@query("read_tables", S.with_(S.BASE + [S.FLAGGED], """SELECT candidate_id, count(*) AS n_flags FROM f
  WHERE flag_kind IS NOT NULL GROUP BY ALL"""))
def read_tables(spark, d):
    from sievework.operators.forensics import timing_flags

    path = new_path(spark, "flags")
    tb.append(timing_flags(fx.candidates(spark, d)).filter(F.col("flag").isNotNull()), path)
    return tb.flag_counts(tb.read_table(spark, path))


@query("append_log", S.with_(S.BASE, """SELECT candidate_id, 'ingested' AS event_type,
  '{"source":"documents","answers_count":3}' AS event_data FROM c"""))
def append_log(spark, d):
    path = new_path(spark, "log")
    at = F.lit("2024-01-01").cast("timestamp")
    tb.append(tb.ingested_log(fx.candidates(spark, d), "documents", at), path)
    return tb.read_table(spark, path).select("candidate_id", "event_type", "event_data")


@query("typed_events", S.with_(S.SCORES + PROCESSED + [S.FLAGGED],
  """SELECT candidate_id, 'score_assigned' AS event_type, tier AS detail, CAST(NULL AS INTEGER) AS round, count(*) AS n FROM s GROUP BY ALL
  UNION ALL SELECT candidate_id, 'email_sent', template, next_round, count(*) FROM pp WHERE advance_round GROUP BY ALL
  UNION ALL SELECT candidate_id, 'reply_received', response_type, round, count(*) FROM cl GROUP BY ALL
  UNION ALL SELECT candidate_id, 'cheat_flagged', 'timing', NULL, count(*) FROM f WHERE severity > 0.5 GROUP BY ALL
  UNION ALL SELECT 'c' || doc_id, 'outcome', CASE quality WHEN 1 THEN 'hired' ELSE 'rejected' END || CASE toxic WHEN 1 THEN ' toxic' ELSE ' ' END,
  NULL, count(*) FROM labels GROUP BY ALL"""))
def typed_events(spark, d):
    from checks.queries_threads import processed
    from sievework.operators import engagement, forensics, scoring

    scores = scoring.score_candidates(fx.candidates(spark, d), explain=False, **fx.SCORE_RULES)
    replies = stage(processed(spark, d), "processed")
    strikes = forensics.timing_strikes(forensics.timing_flags(fx.candidates(spark, d)))
    # Labels as outcomes: good documents are hired, and toxic ones say so in the notes.
    outcomes = fx.table(spark, d, "labels").select(
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        F.when(F.col("quality") == 1, F.lit("hired")).otherwise(F.lit("rejected")).alias("outcome"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("notes"))
    log = tb.typed_events(F.lit("2024-01-01").cast("timestamp"), scores=scores, outbox=engagement.follow_ups(replies),
                          replies=replies, strikes=strikes, outcomes=outcomes)
    field = lambda name: F.get_json_object("event_data", f"$.{name}")
    detail = F.coalesce(*map(field, ("tier", "response_type", "flag_type", "template")),
                        F.concat_ws(" ", field("outcome"), field("notes")))
    return log.select("candidate_id", "event_type", detail.alias("detail"), field("round").cast("int").alias("round")).groupBy(
        "candidate_id", "event_type", "detail", "round").agg(F.count(F.lit(1)).alias("n"))


@query("json_sink", S.with_(S.BASE, "SELECT candidate_id, email, md5(a3) AS answer FROM c"))
def json_sink(spark, d):
    path = new_path(spark, "json")
    tb.json_sink(fx.candidates(spark, d).select("candidate_id", "email", "answers"), path)
    schema = "candidate_id STRING, email STRING, answers ARRAY<STRUCT<answer_text: STRING>>"
    back = spark.read.schema(schema).json(path)
    return back.select("candidate_id", "email", F.md5(F.col("answers")[2]["answer_text"]).alias("answer"))


@query("snapshot_weights", """WITH m AS (SELECT avg(CAST(toxic AS DOUBLE)) AS r FROM labels) SELECT version, dimension, weight FROM (
  SELECT 1 AS version, * FROM (VALUES ('technical_relevance', 0.3), ('answer_quality', 0.25), ('profile_credibility', 0.2), ('specificity', 0.15), ('timing', 0.1)) AS x(dimension, weight)
  UNION ALL SELECT 2, dimension, round_even(w / sum(w) OVER (), 4) FROM (
    SELECT dimension, CASE WHEN dimension = 'specificity' THEN least(0.5, greatest(0.05, weight + greatest(-0.05, -r)))::DOUBLE ELSE weight::DOUBLE END AS w FROM m,
    (VALUES ('technical_relevance', 0.3), ('answer_quality', 0.25), ('profile_credibility', 0.2), ('specificity', 0.15), ('timing', 0.1)) AS y(dimension, weight)))""")
def snapshot_weights(spark, d):
    # The share of toxic labels is what moves the specificity weight here.
    from sievework.operators import learning

    at = F.lit("2024-01-01").cast("timestamp")
    path = new_path(spark, "weights")
    tb.append(tb.weight_rows(spark, lx.WEIGHTS, 1, "initial", at), path)
    stored = tb.read_table(spark, path)
    moved = fx.table(spark, d, "labels").agg((-F.avg(F.col("toxic").cast("double"))).alias("delta"))
    adjustments = moved.select(F.lit("specificity").alias("dimension"), "delta")
    new = learning.apply_weights(tb.current_weights(stored), adjustments)
    tb.append(stage(learning.snapshot_weights(new, stored, "labels", at), "new-weights"), path)
    return tb.read_table(spark, path).select("version", "dimension", "weight")


# ----------------------------------------------------------- text measures


def _measure(name: str, column, sql: str):
    """A text measure over every whole document."""
    @query(name, f"SELECT doc_id, {sql} AS {name} FROM documents")
    def run(spark, d):
        return fx.texts(spark, d, "documents").select("doc_id", column().alias(name))
    return run


_measure("word_count", lambda: tx.word_count("text"), S.wc("text"))
_measure("unique_words_ratio", lambda: tx.unique_words_ratio("text"), S.share("text"))
_measure("hapax_ratio", lambda: tx.hapax_ratio("text"), S.hapax("text"))
_measure("contraction_rate", lambda: tx.contraction_rate("text", lx.CONTRACTION_PATTERN),
         f"{S.hits('lower(text)', S.CONTRACTIONS)} / greatest({S.wc('text')}, 1)")
_measure("normalize_text", lambda: F.md5(tx.normalize_text("text")),
         f"""md5(regexp_replace(regexp_replace({S.strip('lower(text)')}, '\\s+', ' ', 'g'),
           '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}\\s.,;:!?''-]', '', 'g'))""")
_measure("sentence_lengths", lambda: F.array_join(tx.sentence_lengths("text").cast("array<string>"), ","),
         f"array_to_string({S.sentence_lengths('text')}, ',')")
_measure("coef_variation", lambda: tx.round_half_even(tx.coef_variation(tx.sentence_lengths("text")), 6),
         f"""round_even(CASE WHEN len({S.sentence_lengths('text')}) > 0 THEN
           list_aggregate({S.sentence_lengths('text')}, 'stddev_pop') / list_avg({S.sentence_lengths('text')}) ELSE 0.0 END, 6)""")
_measure("phrase_hits", lambda: tx.phrase_hits(F.lower("text"), fx.PHRASES), S.phrases("lower(text)", fx.PHRASES))
_measure("regex_any", lambda: tx.patterns_present("text", [r for r, _ in fx.QUALITY_RULES], ignore_case=True),
         S.total([f"CAST({S.any_('text', r, 'i')} AS INTEGER)" for r, _ in fx.QUALITY_RULES]))
_measure("regex_hits", lambda: tx.add_up([tx.regex_hits(F.lower("text"), r) for r, _ in fx.PATTERNS]),
         S.total([S.hits("lower(text)", r) for r, _ in fx.PATTERNS]))
_measure("preview", lambda: F.md5(tx.preview("text")), "md5(substring(text, 1, 100))")
_measure("clamp", lambda: tx.clamp(tx.word_count("text") / 10.0, 1.0, 50.0),
         f"least(50.0::DOUBLE, greatest(1.0::DOUBLE, {S.wc('text')} / 10.0::DOUBLE))")


@query("first_name", f"SELECT c_custkey, coalesce({S.words('c_name')}[1], 'there') AS first_name FROM customer")
def first_name(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", tx.first_name("c_name").alias("first_name"))
