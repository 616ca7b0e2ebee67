"""Reading messy applicant files into the canonical nested table.

``candidates``: candidate_id, row_id, name, email, role, github_url, linkedin_url,
response_time_seconds, round, answers.  The answers stay in their applicant's row as
``ARRAY<STRUCT<question_id, question_text, answer_text>>``: a file carries all of an
applicant's answers in one record, so nothing needs to be grouped back together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework import lexicons as lx
from sievework.functions import text as tx
from sievework.operators.keyed import computed_once, first_per_key, lookup
from sievework.session import stage
from sievework.sources.csv_records import read_records

FIELDS = list(lx.COLUMN_ALIASES)


def _named(header: str) -> Column:
    return F.col("`" + header.replace("`", "``") + "`")


#: Where ``scan_csv`` keeps a line that does not fit its header.
CORRUPT = "_corrupt_record"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def scan_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True,
             with_row_id: bool = True, missing_ok: bool = False) -> DataFrame:
    """Header CSV, every column a string.

    Files may order their columns differently or lack some and are put together by column
    name.  A line that does not fit its header is kept whole in ``_corrupt_record``.
    ``row_id`` counts the rows in order of file name and line, whatever the number of cores
    and the size of the splits.  Records end with a line feed, or as the header ends, with
    a carriage return before it; blank lines are no records.  A path that cannot be read is an
    error, or an empty frame if ``missing_ok``.

    Files are split wherever they are long, also those with line breaks inside quotes
    (``csv_records``).  They are scanned once now, for states and row numbers, and when the rows
    are used once for the records within a split and, with ``multi_line``, once for those that
    splits cut; nothing is written.  Without such line breaks ``multi_line=False``
    saves looking at the quotes.
    """
    try:
        records, headers = read_records(spark, path, multi_line)
    except AnalysisException:
        if not missing_ok:
            raise
        records, headers = None, []
    if records is None:
        ids = T.StructType([T.StructField("row_id", T.LongType())] if with_row_id else [])
        return spark.createDataFrame([], ids)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = list(dict.fromkeys([*headers[0], CORRUPT, *(n for header in headers for n in header)]))
    parsed = {}
    for k, header in enumerate(headers):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*header, CORRUPT)])
        parsed[f"__{k}"] = F.when(F.col("header") == k, F.from_csv(F.col("record").cast("string"), _ddl(schema), options))
    once = computed_once(records, parsed)
    columns = []
    for name in names:
        having = [F.col(f"__{k}")[name] for k, header in enumerate(headers) if name == CORRUPT or name in header]
        columns.append(F.coalesce(*having).alias(name))
    return once.select(*columns, *(["row_id"] if with_row_id else []))


def parse_errors(raw: DataFrame) -> DataFrame:
    """The lines of a scan that do not fit their header: ``row_id``, ``line``, ``reject_reason``."""
    return raw.filter(F.col(CORRUPT).isNotNull()).select(
        "row_id", F.col(CORRUPT).alias("line"), F.lit("parse_error").alias("reject_reason"))


def find_column(headers: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The header equal to the earliest alias, ignoring case and outer blanks."""
    by_name: dict[str, str] = {}
    for header in headers:
        by_name.setdefault(header.lower().strip(), header)
    return next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)


def find_question_cols(headers: Sequence[str]) -> list[str]:
    """Headers that start with ``q`` and a digit, in lexicographic order."""
    def is_question(header: str) -> bool:
        key = header.strip().lower()
        return key[:1] == "q" and key[1:2].isdigit()

    return sorted(filter(is_question, headers))


def question_parts(header: str) -> tuple[str, str]:
    """Question id and readable text of a question header."""
    qid, sep, rest = header.partition("_")
    if not sep:
        return header, header
    return qid, rest.replace("_", " ").capitalize() + "?"


def na_to_null(c: Column | str, tokens: Sequence[str] = lx.NA_TOKENS) -> Column:
    """Null for missing markers, also for ``nan`` between blanks."""
    column = F.col(c) if isinstance(c, str) else c
    marked = F.array_contains(tx.strings(tokens), column)
    return F.when(~marked & (tx.strip(column) != "nan"), column)


def resolve_columns(raw: DataFrame, aliases: Mapping[str, Sequence[str]] = lx.COLUMN_ALIASES,
                    na_tokens: Sequence[str] = lx.NA_TOKENS) -> DataFrame:
    """Canonical string columns, nulls for missing cells, and one ``answers`` array.

    A field without a matching header is null; ``response_time_seconds`` is then the
    text ``0`` because an absent column, unlike an absent cell, means no timing data.
    """
    headers = [h for h in raw.columns if h != "row_id"]
    picked = []
    for field, names in aliases.items():
        header = find_column(headers, names)
        absent = F.lit("0" if field == "response_time_seconds" else None).cast("string")
        picked.append((na_to_null(_named(header), na_tokens) if header else absent).alias(field))
    answers = []
    for header in find_question_cols(headers):
        qid, question = question_parts(header)
        body = tx.strip(F.coalesce(na_to_null(_named(header), na_tokens), F.lit("")))
        answers.append(F.struct(
            F.lit(qid).alias("question_id"), F.lit(question).alias("question_text"),
            body.alias("answer_text")))
    kind = "array<struct<question_id:string,question_text:string,answer_text:string>>"
    listed = F.array(*answers).cast(kind)
    return raw.select("row_id", *picked, listed.alias("answers"))


# ------------------------------------------------------------- normalisers


def norm_email(c: Column | str) -> Column:
    lowered = F.lower(tx.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return F.when(F.contains(lowered, F.lit("@")), lowered).otherwise(F.lit(""))


def norm_name(c: Column | str) -> Column:
    return F.array_join(tx.words(c), " ")


def norm_profile_url(c: Column | str, domain: str, prefix: str) -> Column:
    """A bare handle becomes a full URL; anything with the domain or a scheme stays."""
    value = tx.strip(F.col(c) if isinstance(c, str) else c)
    full = F.contains(F.lower(value), F.lit(domain)) | F.startswith(value, F.lit("http"))
    return F.when(value != "", F.when(full, value).otherwise(F.concat(F.lit(prefix), value)))


def norm_github(c: Column | str) -> Column:
    return norm_profile_url(c, "github.com", "https://github.com/")


def norm_linkedin(c: Column | str) -> Column:
    return norm_profile_url(c, "linkedin.com", "https://linkedin.com/in/")


def fill_ids(candidate_id: Column | str, row_id: Column | str = "row_id") -> Column:
    cid = tx.strip(F.col(candidate_id) if isinstance(candidate_id, str) else candidate_id)
    rid = (F.col(row_id) if isinstance(row_id, str) else row_id).cast("string")
    return F.coalesce(F.when(cid != "", cid), F.concat(F.lit("auto_"), rid))


def lenient_number(c: Column | str) -> Column:
    """A number, NaN for a missing cell, 0 for anything else."""
    value = tx.strip(F.col(c) if isinstance(c, str) else c)
    numeric = value.rlike(r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$")
    parsed = F.when(numeric, value.try_cast("double"))
    return F.when(value.isNull(), F.lit(float("nan"))).otherwise(F.coalesce(parsed, F.lit(0.0)))


# ------------------------------------------------- validity and duplicates


def lacks_identity(email: Column | str = "email", name: Column | str = "name") -> Column:
    """No usable email and no name."""
    e = F.coalesce(F.col(email) if isinstance(email, str) else email, F.lit(""))
    n = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return ~F.contains(e, F.lit("@")) & (tx.strip(n) == "")


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(~lacks_identity())


def application_key(missing_email_matches: bool = True, unique: Column | str = "row_id") -> Column:
    """Lower-cased email and role.

    People without an email share one key per role, as in the rules this follows;
    with ``missing_email_matches=False`` they keep one key each.
    """
    email = F.lower(tx.strip("email"))
    present = F.when(email != "", email)
    if missing_email_matches:
        absent = F.lit("nan")
    else:
        rid = F.col(unique) if isinstance(unique, str) else unique
        absent = F.concat(F.lit("nan#"), rid.cast("string"))
    role = F.lower(F.coalesce(tx.strip("role"), F.lit("nan")))
    return F.concat(F.coalesce(present, absent), F.lit("|"), role)


def dedup_first(df: DataFrame, missing_email_matches: bool = True) -> DataFrame:
    """The first row of each email and role, in ``row_id`` order."""
    keyed = df.withColumn("__key", application_key(missing_email_matches))
    return first_per_key(keyed, ["__key"]).drop("__key")


def dedup_identity(df: DataFrame) -> DataFrame:
    """The first row per email, or per name without one; rows with neither go."""
    email = F.when(F.coalesce(F.col("email"), F.lit("")) != "", F.lower("email"))
    keyed = df.withColumn("__key", F.coalesce(email, F.lower("name"), F.lit("")))
    return first_per_key(keyed.filter(F.col("__key") != ""), ["__key"]).drop("__key")


def with_reject_reason(df: DataFrame, missing_email_matches: bool = True) -> DataFrame:
    """Adds ``reject_reason`` (null for kept rows) and ``duplicate_of``.

    Rows without identity are set apart first and never shadow a later duplicate.
    """
    checked = df.withColumn("__key", application_key(missing_email_matches))
    unusable = checked.filter(lacks_identity()).withColumns({
        "reject_reason": F.lit("no_identity"), "duplicate_of": F.lit(None).cast("string")})
    usable = checked.filter(~lacks_identity())
    firsts = usable.groupBy("__key").agg(
        F.min("row_id").alias("__first"),
        F.min_by(fill_ids("candidate_id"), "row_id").alias("__first_id"))
    is_copy = F.col("row_id") != F.col("__first")
    judged = lookup(usable, firsts, ["__key"]).withColumns({
        "reject_reason": F.when(is_copy, F.lit("duplicate")),
        "duplicate_of": F.when(is_copy, F.col("__first_id")),
    }).drop("__first", "__first_id")
    return judged.unionByName(unusable).drop("__key")


def rejected_rows(df: DataFrame, missing_email_matches: bool = True) -> DataFrame:
    return with_reject_reason(df, missing_email_matches).filter(F.col("reject_reason").isNotNull())


def ingest_counts(df: DataFrame, missing_email_matches: bool = True) -> DataFrame:
    """Rows read, kept and skipped by reason, from one aggregate of keys."""
    checked = df.select(application_key(missing_email_matches).alias("__key"),
                        lacks_identity().alias("__bad"))
    per_key = checked.groupBy("__bad", "__key").agg(F.count(F.lit(1)).alias("__n"))
    good = ~F.col("__bad")
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_read"),
        F.count_if(good).alias("kept"),
        F.coalesce(F.sum(F.when(good, F.col("__n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("__bad"), F.col("__n"))), F.lit(0)).alias("no_identity"),
    )


def normalise(df: DataFrame) -> DataFrame:
    """Canonical candidates from resolved columns."""
    return df.select(
        fill_ids("candidate_id").alias("candidate_id"), "row_id",
        norm_name("name").alias("name"), norm_email("email").alias("email"),
        tx.strip(F.coalesce("role", F.lit(""))).alias("role"),
        norm_github("github_url").alias("github_url"),
        norm_linkedin("linkedin_url").alias("linkedin_url"),
        lenient_number("response_time_seconds").alias("response_time_seconds"),
        F.lit(1).alias("round"), "answers",
    )


def clean_applicants(raw: DataFrame, aliases=lx.COLUMN_ALIASES, na_tokens=lx.NA_TOKENS,
                     missing_email_matches: bool = True) -> DataFrame:
    """Raw strings with a ``row_id`` to candidates: resolve, validate, keep first, normalise."""
    fitting = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in raw.columns else raw
    resolved = resolve_columns(fitting, aliases, na_tokens)
    return normalise(dedup_first(valid_rows(resolved), missing_email_matches))


def read_applicants(spark: SparkSession, path: str, multi_line: bool = True, **options) -> DataFrame:
    """File to canonical candidates."""
    return clean_applicants(scan_csv(spark, path, multi_line), **options)


def ingest(spark: SparkSession, path: str, **options) -> DataFrame:
    """``read_applicants`` followed by the second, identity-only pass."""
    return dedup_identity(read_applicants(spark, path, **options))


def reject_table(raw: DataFrame, missing_email_matches: bool = True) -> DataFrame:
    """Every row of a scan that ingestion leaves out, with its reason: ``row_id``,
    ``reject_reason``, ``duplicate_of``, ``line``.

    ``parse_error`` lines keep their text; ``no_identity`` and ``duplicate`` are those of the
    first pass, ``same_identity`` the rows that repeat a person in the second.
    """
    broken, resolved = raw.limit(0), raw
    if CORRUPT in raw.columns:
        broken, resolved = raw.filter(F.col(CORRUPT).isNotNull()), raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    resolved = resolve_columns(resolved)
    nothing = F.lit(None).cast("string")
    lines = broken.select(F.col("row_id"), F.lit("parse_error").alias("reject_reason"), nothing.alias("duplicate_of"),
                          (F.col(CORRUPT) if CORRUPT in raw.columns else nothing).alias("line"))
    first = rejected_rows(resolved, missing_email_matches).select(
        "row_id", "reject_reason", "duplicate_of", nothing.alias("line"))
    kept = normalise(dedup_first(valid_rows(resolved), missing_email_matches))
    second = kept.join(dedup_identity(kept).select("row_id"), "row_id", "left_anti").select(
        "row_id", F.lit("same_identity").alias("reject_reason"), nothing.alias("duplicate_of"), nothing.alias("line"))
    return lines.unionByName(first).unionByName(second)


def run_ingestion(raw: DataFrame, folder: str, source: str, at: Column, buckets: int = 64,
                  missing_email_matches: bool = True) -> DataFrame:
    """Ingest a scan into the tables under ``folder`` and return the run in one row.

    Candidates of both passes are upserted into ``candidates`` by email and role, each is
    logged in ``interactions``, what was left out is appended to ``rejects``.  ``status`` is
    ``error`` without a candidate, ``partial`` if lines could not be parsed, else ``success``;
    the counts are rows read, kept, and left out by reason.
    """
    from sievework.sources import tables

    raw = stage(raw, "scan")
    rejects = stage(reject_table(raw, missing_email_matches), "rejects")
    people = stage(dedup_identity(clean_applicants(raw, missing_email_matches=missing_email_matches)), "people")
    tables.upsert_into(people, f"{folder}/candidates", buckets=buckets)
    tables.append(tables.ingested_log(people, source, at), f"{folder}/interactions")
    tables.append(rejects.withColumns({"source": F.lit(source), "rejected_at": at}), f"{folder}/rejects")
    reasons = {"parse_errors": "parse_error", "no_identity": "no_identity", "duplicates": "duplicate",
               "same_identity": "same_identity"}
    counts = rejects.agg(*[F.count_if(F.col("reject_reason") == r).alias(n) for n, r in reasons.items()])
    kept = people.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select(
        F.lit(source).alias("source"), kept.alias("kept"), *reasons).select(
        "source", F.when(F.col("kept") == 0, F.lit("error")).when(F.col("parse_errors") > 0, F.lit("partial"))
        .otherwise(F.lit("success")).alias("status"),
        (F.col("kept") + sum((F.col(n) for n in reasons), F.lit(0))).alias("rows_read"), "kept", *reasons)


# ----------------------------------------------------------------- reshaping


def unpivot_answers(raw: DataFrame, ids: Sequence[str], na_tokens=lx.NA_TOKENS) -> DataFrame:
    """Wide question columns to one row per answer; an empty answer keeps its row."""
    headers = find_question_cols(raw.columns)
    long = raw.unpivot(list(ids), [_named(h) for h in headers], "__header", "__text")
    underscore = F.instr("__header", "_") > 0
    rest = F.replace(F.regexp_replace("__header", "^[^_]*_", ""), F.lit("_"), F.lit(" "))
    sentence = F.concat(F.upper(F.substring(rest, 1, 1)),
                        F.lower(rest.substr(F.lit(2), F.length(rest))), F.lit("?"))
    return long.select(
        *ids, F.substring_index("__header", "_", 1).alias("question_id"),
        F.when(underscore, sentence).otherwise(F.col("__header")).alias("question_text"),
        tx.strip(F.coalesce(na_to_null("__text", na_tokens), F.lit(""))).alias("answer_text"),
    )


def flatten_answers(candidates: DataFrame) -> DataFrame:
    """One row per answer with its position; applicants without answers give none."""
    keep = [c for c in ("candidate_id", "row_id", "name") if c in candidates.columns]
    return candidates.select(*keep, F.posexplode("answers").alias("pos", "a")).select(
        *keep, "pos", "a.question_id", "a.question_text", "a.answer_text")


def nest_answers(answers: DataFrame, key: str = "candidate_id", position: str = "pos") -> DataFrame:
    """Answer rows back to one array per applicant, in question order.

    The group is one applicant's own answers, which the questionnaire bounds.
    """
    item = F.struct(position, "question_id", "question_text", "answer_text")
    grouped = answers.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("answers"))
    return grouped.withColumn("answers", F.transform("answers", lambda a: F.struct(
        a["question_id"].alias("question_id"), a["question_text"].alias("question_text"),
        a["answer_text"].alias("answer_text"))))
