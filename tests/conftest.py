import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sievework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Builds canonical candidates from short dictionaries."""
    schema = ("candidate_id STRING, row_id BIGINT, name STRING, email STRING, role STRING, github_url STRING, "
              "linkedin_url STRING, response_time_seconds DOUBLE, round INT, "
              "answers ARRAY<STRUCT<question_id: STRING, question_text: STRING, answer_text: STRING>>")

    def build(*rows):
        out = []
        for i, row in enumerate(rows):
            answers = [(f"q{k + 1}", f"Question {k + 1}?", t) for k, t in enumerate(row.get("answers", []))]
            out.append((row.get("id", f"p{i}"), i, row.get("name", f"Person {i}"), row.get("email", f"p{i}@x.test"),
                        row.get("role", "AI Agent Developer"), row.get("github"), row.get("linkedin"),
                        row.get("seconds", 100.0), 1, answers))
        return spark.createDataFrame(out, schema)
    return build
