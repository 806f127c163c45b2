from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions import extract
from lettermill.functions.scoring import id_label, label_id, top_label
from lettermill.functions.text import any_pattern, first_words, is_blank, squeeze, strip, text_array


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


# Fixed values in the next four tests: known texts and what they must give.
def test_rejection_types(spark):
    cases = {
        "After careful review we will not be moving forward with your application.": "hard_rejection",
        "We regret to inform you that you were not selected for this role.": "hard_rejection",
        "We have chosen to pursue another candidate whose experience more closely matches.": "hard_rejection",
        "We will keep your resume on file and reach out for future opportunities.": "soft_rejection",
        "We'd love to stay in touch and consider you for future openings.": "soft_rejection",
        "Thank you for your time during the interview process.": "unknown",
        "We will not be moving forward but will keep your resume on file.": "hard_rejection",
        "we will reach out when a\rnew position": "soft_rejection",
        "we will reach out when a\nnew position": "unknown",
        "": "unknown",
    }
    assert apply(spark, extract.rejection_type, cases) == list(cases.values())


def test_role_titles(spark):
    cases = {
        "Your application for Software Engineer at Stripe has been received.": "Software Engineer",
        "We reviewed your application for Senior ML Engineer.": "Senior ML Engineer",
        "Thank you for applying to the Data Scientist II position.": "Data Scientist II",
        "Thank you for your interest in our company.": "",
        "misread": "sre",
        "Data Scientist in NYC": "Data Scientist i",
        "for Senior  ML Engineer II": "Senior ML Engineer II",
        "Mid-Level Software Engineer": "Mid-Level Software Engineer",
        "FULLSTACK ENGINEER 3": "FULLSTACK ENGINEER 3",
    }
    assert apply(spark, extract.role_title, cases) == list(cases.values())


def test_whole_word_roles(spark):
    found = apply(
        spark, lambda v: extract.role_title(v, whole_words=True),
        ["misread", "an SRE role", "Data Scientist in NYC"],
    )
    assert found == ["", "SRE", "Data Scientist"]


def test_companies(spark):
    cases = {
        "jobs@stripe.com": "Stripe",
        "user@gmail.com": "",
        "no-reply@greenhouse-mail.io": "",
        "hr@jobs.acme.com": "Acme",
        "candice@fabrikam.co.uk": "Co",
        "x@clever.com": "",
        "root@localhost": "Localhost",
        "Talent <jobs@LinkedIn.com>": "Linkedin",
        "no-at-sign": "",
        "": "",
        None: "",
    }
    assert apply(spark, extract.sender_company, cases) == list(cases.values())


def test_boards(spark):
    cases = {
        "jobs@linkedin.com": "LinkedIn",
        "noreply@indeed.com": "Indeed",
        "no-reply@greenhouse.io": "Greenhouse",
        "hr@stripe.com": "company_direct",
        "candice@x.com": "Dice",
        "a@icims.com": "iCIMS",
        "a@wd5.myworkdayjobs.com": "Workday",
        None: "company_direct",
    }
    assert apply(spark, extract.job_board, cases) == list(cases.values())
    ingest = apply(
        spark, lambda v: extract.job_board(v, rules.INGEST_JOB_BOARDS), ["a@icims.com", "a@dice.com"]
    )
    assert ingest == ["company_direct", "Dice"]


def test_first_entity(spark):
    rows = [(["LinkedIn", " ab ", " Acme Corp "],), (["The", "x"],), ([],), (None,), ([None, "Stripe"],)]
    df = spark.createDataFrame(rows, "c array<string>")
    out = [r[0] for r in df.select(extract.first_entity(F.col("c"))).collect()]
    assert out == ["Acme Corp", "", "", "", "Stripe"]


def test_labels(spark):
    rows = [
        (["hard_rejection", "soft_rejection", "unknown"], [0.88, 0.08, 0.04], 0.45),
        (["hard_rejection", "soft_rejection", "unknown"], [0.55, 0.30, 0.15], 0.9),
        (["hard_rejection", "soft_rejection", "unknown"], [0.1, 0.45, 0.45], 0.45),
        (["unknown", "hard_rejection"], [0.2, 0.8], 0.45),
    ]
    df = spark.createDataFrame(rows, "l array<string>, s array<double>, t double")
    out = [r[0] for r in df.select(top_label(F.col("l"), F.col("s"), F.col("t"))).collect()]
    assert out == ["hard_rejection", "unknown", "soft_rejection", "hard_rejection"]


def test_label_ids_follow_the_declared_order(spark):
    df = spark.createDataFrame([(x,) for x in [*rules.REJECTION_LABELS, "other", None]], "l string")
    rows = df.select(label_id(F.col("l")).alias("n")).withColumn("back", id_label(F.col("n"))).collect()
    assert [r["n"] for r in rows] == [0, 1, 2, None, None]
    assert [r["back"] for r in rows] == [*rules.REJECTION_LABELS, None, None]


def test_words(spark):
    text = " a b\x1f\n c " * 300
    assert apply(spark, lambda v: first_words(v, 400), [text]) == [" ".join(text.split()[:400])]
    assert apply(spark, squeeze, [text]) == [" ".join(text.split())]
    assert apply(spark, strip, ["  x \x1c", ""]) == ["x", ""]
    assert apply(spark, is_blank, ["  \n ", "", None, "x"]) == [True, True, True, False]


def test_first_letter_test_is_left_out_where_it_could_be_wrong():
    for patterns in (["a?b"], ["(x|y)z"], ["ab|cd"], [r"\w+"], ["ok", "s*t"], ["a(b|c)|d"]):
        assert "(?=" not in any_pattern(patterns)
    assert "(?=" in any_pattern(rules.HARD_REJECTION_PATTERNS)


PIECES = st.sampled_from(
    [p.replace("\\s+", " ") for p in ("Senior", "ML\\s+Engineer", "Data\\s+Scientist", "IV", "3", "SRE")]
    + ["ſre", "DATA  ſcientist", "data analyſt", "devopſ engineer", "MLOps\tEngineer", "backend engineer"]
    + ["not selected", "NOT ſelected", "keep your cv on file", "reach out if a position", "stay in touch"]
    + ["no longer conſidered", "another candidate", "will not be movıng forward", "K", "é", "x" * 40, "\n"]
)


def plain_role(text: str) -> str:
    found = re.search(rules.ROLE_PATTERN, text, re.IGNORECASE)
    return " ".join(found.group(0).split()) if found else ""


def plain_type(text: str) -> str:
    for label, patterns in (
        ("hard_rejection", rules.HARD_REJECTION_PATTERNS),
        ("soft_rejection", rules.SOFT_REJECTION_PATTERNS),
    ):
        if any(re.search(p, text, re.IGNORECASE) for p in patterns):
            return label
    return "unknown"


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=8).map(" ".join), min_size=50, max_size=120))
def test_patterns_agree_with_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", extract.role_title(F.col("t")).alias("role"), extract.rejection_type(F.col("t")).alias("kind")
    ).orderBy("i").collect()
    assert [r["role"] for r in rows] == [plain_role(t) for t in texts]
    assert [r["kind"] for r in rows] == [plain_type(t) for t in texts]


def test_empty_text_array(spark):
    assert spark.range(1).select(F.size(text_array([]))).first()[0] == 0
