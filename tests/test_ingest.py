import math

import pytest
from pyspark.sql import functions as F

from sievework.session import new_path
from sievework.sources import applicants as ap
from sievework.sources import tables as tb

CSV = '''Applicant_ID , Full_Name,EMAIL_ADDRESS,Position,github,LinkedIn,q10_last_one,q2_hard_case,q3,Time_Taken
007,"Ann  Lee",Ann@X.Test,Engineer,annlee,,"ten, ""quoted""","two
lines",,12.5
008,Bob,ann@x.test ,engineer,,bob,x,y,z,abc
,Cy,,Engineer,HTTPS://GitHub.com/cy,http://own.site,NA,null,nan,
n2,Di,,Engineer,  ,N/A,a,b,c,5d
x1,,no-at-sign,Engineer,,,a,b,c,1
x2,nan,,Engineer,,,a,b,c,1
x3,Eve,eve@x.test,Designer,,,a,b,c,-3
x4,Eve,EVE@X.TEST,Painter,,,a,b,c,1e2
'''


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "people.csv"
    path.write_text(CSV)
    return ap.scan_csv(spark, str(path))


def test_scan_keeps_strings_quotes_and_lines(raw):
    rows = {r["Applicant_ID "]: r for r in raw.collect()}
    assert raw.count() == 8 and rows["007"]["q10_last_one"] == 'ten, "quoted"'
    assert rows["007"]["q2_hard_case"] == "two\nlines"
    assert sorted(r["row_id"] for r in rows.values()) == list(range(8))


def test_a_missing_path_is_an_error_unless_allowed(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ap.scan_csv(spark, str(tmp_path / "missing.csv"))
    assert ap.scan_csv(spark, str(tmp_path / "missing.csv"), missing_ok=True).count() == 0


@pytest.mark.parametrize("multi_line,split", [(True, "128m"), (False, "128m"), (False, "200b")])
def test_files_with_other_column_order_and_broken_lines(spark, tmp_path, multi_line, split):
    (tmp_path / "b one.csv").write_text("email,name,id\n" + "".join(f"b{k}@x.test,Bob {k},b{k}\n" for k in range(40)))
    (tmp_path / "a.csv").write_text("id,name,email,q1_x\na1,Ann,a@x.test,yes\na2,Al,al@x.test,no,too,many\na3,Ada\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        raw = ap.scan_csv(spark, str(tmp_path), multi_line=multi_line)
        rows = {r.row_id: r for r in raw.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(rows) == list(range(43))
    assert (rows[0].id, rows[0].name, rows[0].email, rows[0].q1_x) == ("a1", "Ann", "a@x.test", "yes")
    assert [(rows[3 + k].id, rows[3 + k].email, rows[3 + k].q1_x) for k in range(40)] == [(f"b{k}", f"b{k}@x.test", None) for k in range(40)]
    assert [(r.row_id, r.line, r.reject_reason) for r in ap.parse_errors(raw).orderBy("row_id").collect()] == [
        (1, "a2,Al,al@x.test,no,too,many", "parse_error"), (2, "a3,Ada", "parse_error")]
    assert ap.clean_applicants(raw).count() == 41


def test_columns_and_questions(raw):
    assert ap.find_column(["x", " Full_Name"], ["name", "full_name"]) == " Full_Name"
    assert ap.find_column(["x"], ["name"]) is None
    assert ap.find_question_cols(["q2_b", "q10_a", "question_1", "Q1", "q"]) == ["Q1", "q10_a", "q2_b"]
    assert ap.question_parts("q1_what_Is_it") == ("q1", "What is it?") and ap.question_parts("q3") == ("q3", "q3")
    resolved = ap.resolve_columns(raw)
    row = resolved.filter("candidate_id = '007'").first()
    assert [(a.question_id, a.question_text, a.answer_text) for a in row.answers] == [
        ("q10", "Last one?", 'ten, "quoted"'), ("q2", "Hard case?", "two\nlines"), ("q3", "q3", "")]


def test_clean_applicants(raw):
    rows = {r.candidate_id: r for r in ap.clean_applicants(raw).collect()}
    # 008 repeats 007's email and role; n2 has no email in a role where cy came first.
    assert set(rows) == {"007", "auto_2", "x3", "x4"}
    ann, cy = rows["007"], rows["auto_2"]
    assert (ann.name, ann.email, ann.github_url, ann.linkedin_url) == (
        "Ann Lee", "ann@x.test", "https://github.com/annlee", None)
    assert ann.response_time_seconds == 12.5 and math.isnan(cy.response_time_seconds)
    assert cy.github_url == "HTTPS://GitHub.com/cy" and cy.linkedin_url == "http://own.site"
    assert [a.answer_text for a in cy.answers] == ["", "", ""]


def test_missing_emails_apart(raw):
    rows = ap.clean_applicants(raw, missing_email_matches=False)
    assert {r.candidate_id for r in rows.collect()} == {"007", "auto_2", "n2", "x3", "x4"}


def test_rejects_and_counts(raw):
    resolved = ap.resolve_columns(raw)
    rejected = {r.candidate_id: (r.reject_reason, r.duplicate_of) for r in ap.rejected_rows(resolved).collect()}
    assert rejected == {"008": ("duplicate", "007"), "n2": ("duplicate", "auto_2"),
                        "x1": ("no_identity", None), "x2": ("no_identity", None)}
    assert ap.ingest_counts(resolved).first().asDict() == {
        "rows_read": 8, "kept": 4, "duplicates": 2, "no_identity": 2}


def test_second_pass_ignores_role(raw):
    kept = ap.dedup_identity(ap.clean_applicants(raw))
    assert {r.candidate_id for r in kept.collect()} == {"007", "auto_2", "x3"}


def test_lenient_number(spark):
    texts = ["3", " 2.5 ", "1e2", "5d", "abc", "", None, ".5", "-1", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(ap.lenient_number("t")).collect()]
    assert got[:6] == [3.0, 2.5, 100.0, 0.0, 0.0, 0.0] and math.isnan(got[6])
    assert got[7:] == [0.5, -1.0, math.inf]


def test_absent_time_column_is_zero(spark):
    raw = spark.createDataFrame([(0, "Ann", "a@x.test")], "row_id BIGINT, name STRING, email STRING")
    assert ap.normalise(ap.resolve_columns(raw)).first().response_time_seconds == 0.0


def test_long_and_nested_forms_agree(raw):
    resolved = ap.normalise(ap.resolve_columns(raw))
    long = ap.unpivot_answers(raw, ["row_id"])
    flat = ap.flatten_answers(resolved)
    key = ["row_id", "question_id", "question_text", "answer_text"]
    assert sorted(map(tuple, long.select(key).collect())) == sorted(map(tuple, flat.select(key).collect()))
    back = ap.nest_answers(flat).join(resolved.select("candidate_id", F.col("answers").alias("was")), "candidate_id")
    assert all(r.answers == r.was for r in back.collect()) and back.count() == resolved.count()


def test_upsert_keeps_old_id(spark):
    schema = "candidate_id STRING, row_id BIGINT, email STRING, role STRING, name STRING"
    old = spark.createDataFrame([("a", 0, "a@x", "r", "old"), ("b", 1, "b@x", "r", "stay")], schema)
    new = spark.createDataFrame([("z", 5, "a@x", "r", "new"), ("c", 6, "c@x", "r", "one"), ("d", 7, "c@x", "r", "two")], schema)
    got = {(r.candidate_id, r.name) for r in tb.upsert_candidates(old, new).collect()}
    assert got == {("a", "new"), ("b", "stay"), ("c", "two")}


def test_scores_and_logs(spark):
    path = new_path(spark, "test-scores")
    schema = "candidate_id STRING, total_score DOUBLE, tier STRING, scored_at INT"
    old = spark.createDataFrame([("a", 1.0, "Reject", 1), ("b", 2.0, "Reject", 1)], schema)
    new = spark.createDataFrame([("a", 9.0, "Review", 2)], schema)
    assert {(r.candidate_id, r.total_score) for r in tb.replace_scores(old, new).collect()} == {("a", 9.0), ("b", 2.0)}
    at = F.lit("2024-01-01").cast("timestamp")
    tb.append(tb.scored_log(old, at), path)
    tb.append(tb.scored_log(new, at), path)
    assert tb.read_table(spark, path).count() == 3
    assert [r.event_data for r in tb.read_table(spark, path, "b").collect()] == ['{"total_score":2.0,"tier":"Reject"}']
    assert {(r.candidate_id, r.n_flags) for r in tb.flag_counts(tb.read_table(spark, path)).collect()} == {("a", 2), ("b", 1)}


def test_typed_events(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    outcomes = spark.createDataFrame([("a", "hired", None)], "candidate_id STRING, outcome STRING, notes STRING")
    sent = spark.createDataFrame([("a", "initial_outreach", 1)], "candidate_id STRING, template STRING, round INT")
    log = tb.typed_events(at, outbox=sent, outcomes=outcomes).collect()
    assert {(r.event_type, r.event_data) for r in log} == {
        ("email_sent", '{"template":"initial_outreach","round":1}'), ("outcome", '{"outcome":"hired","notes":""}')}
