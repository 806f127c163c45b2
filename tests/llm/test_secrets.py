from __future__ import annotations

import re

import pytest

from lettermill.llm import queries, secrets
from tests.conftest import plan_of
from tests.llm.helpers import DOCS, LONG, ODD, documents, rows_of, texts_of

HEX = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return queries.secret_forest(spark, docs)


def test_candidates_and_their_neighbours(spark):
    text = f'see the token = "{HEX}" here, not wordswithoutdigits or short1 but 4034685168925054.'
    found = secrets.candidates(documents(spark, [(1, text)])).collect()
    assert [(r["word_at"], r["value"], r["before2"], r["before"], r["after"]) for r in found] == [
        (4, HEX, "token", "=", "here,"), (11, "4034685168925054", "short1", "but", ""),
    ]


def test_held_out_findings_are_told_apart(spark, model):
    words, forest = model
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = secrets.labelled_findings(docs, "source", 800)
    found = secrets.judged(secrets.candidates(held, "path", ("label",)), words, forest).collect()
    right = [r["is_secret"] == (r["label"] == 1) for r in found]
    assert len(right) > 600 and sum(right) / len(right) > 0.95


def test_query_finds_the_tokens_and_leaves_numbers(spark, model):
    """In the given tables the tokens are quoted behind a name; cards, mail and addresses are not secrets."""
    words, forest = model
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = texts_of("/root/testdata/sf0.01")
    found = secrets.scan_secrets(docs, words, forest, "source").collect()
    said = {(r["doc_id"], r["value"]) for r in found if r["is_secret"]}
    planted = {(i, v) for i, t in texts.items() for v in re.findall(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert planted and len(said & planted) >= 0.98 * len(planted)
    assert len(said - planted) <= 0.05 * len(found)


def test_forest_is_the_same_again(spark, model, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second = (rows_of(queries.op10_secret_scan(spark, sf_dir)) for _ in range(2))
    assert first == second
    assert docs.count() > 0 and len(first) > 0


def test_redaction_keeps_rows_and_columns(spark, model):
    words, forest = model
    text = f'with token = "{HEX}" of'
    docs = documents(spark, [*ODD, (30, text), (30, text), (None, text), (31, LONG + text)], "secret_key")
    out = secrets.redact_secrets(docs, words, forest, "source")
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = out.collect()
    assert not any(r["text"] and HEX in r["text"] for r in rows)
    assert sum(bool(r["text"]) and 'token = "[SECRET]" of' in r["text"] for r in rows) == 4
    before = sorted((repr(t) for _, t in ODD))
    assert sorted(repr(r["text"]) for r in rows if not (r["text"] and "SECRET" in r["text"])) == before


def test_odd_rows_and_no_forest(spark, model):
    words, _ = model
    empty = spark.createDataFrame([], DOCS)
    assert secrets.fit_forest(secrets.labelled_findings(empty), words) is None
    docs = documents(spark, [*ODD, (30, f"key={HEX}")], "value")
    found = secrets.scan_secrets(docs, words, None).collect()
    assert [(r["doc_id"], r["value"], r["is_secret"]) for r in found] == [(30, HEX, True)]
    assert secrets.scan_secrets(empty, words, model[1]).count() == 0
    assert secrets.redact_secrets(empty, words, model[1]).count() == 0


def test_main_path_has_no_python(spark, model, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = secrets.scan_secrets(docs, *model, "source")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def values_of(spark, text: str) -> list[tuple[str, str]]:
    found = secrets.candidates(documents(spark, [(1, text)])).orderBy("word_at", "part_at").collect()
    return [(r["value"], r["before"]) for r in found]


def test_all_values_in_a_word_are_candidates(spark):
    url = f"https://api.example.com/v1/list?token=ghp_{HEX}&page=2"
    assert values_of(spark, url) == [("//api.example.com/v1/list", "https:"), (f"ghp_{HEX}", "?token=")]
    line = f'{{"user":"longusername1","secret":"{HEX}","other":"{HEX[::-1]}"}}'
    assert [v for v, _ in values_of(spark, line)] == ["longusername1", HEX, HEX[::-1]]
    assert [v for v, _ in values_of(spark, f"{HEX},{HEX[::-1]};client_secret_key=A{HEX}==")] == [HEX, HEX[::-1], f"A{HEX}=="]
    assert len(values_of(spark, ",".join(f"{HEX}{k}" for k in range(500)))) == 500


def test_short_values_behind_names_are_candidates(spark):
    for text, value in (
        ("password=hunter2222", "hunter2222"), ('password="P@ssw0rd!24"', "P@ssw0rd!24"), ("pwd: $ecr3t&x", "$ecr3t&x"), ("https://a.example.com?pwd=ab3d&5xyz&page=2", "ab3d&5xyz"),
        ('the "password": "P@ss,w0rd"', "P@ss,w0rd"), ("password letme1n", "letme1n"), ("secret='$x$y$z'", "$x$y$z"),
    ):
        assert [v for v, _ in values_of(spark, text) if "example" not in v] == [value], text


def test_later_and_short_secrets_are_redacted(spark, model):
    texts = [f"see https://api.example.com/v1/list?token={HEX} now", f'{{"user":"longusername1","secret":"{HEX}"}}', 'set password="Px@w0rdQ!24" there']
    out = secrets.redact_secrets(documents(spark, list(enumerate(texts))), *model).collect()
    assert all("[SECRET]" in r["text"] and HEX not in r["text"] and "w0rdQ" not in r["text"] for r in out), out


def masked_plainly(text: str, rows: list, mask: str = "[SECRET]") -> str:
    """The plain rule: in each word the candidates' values are replaced from left to right, each at its own place."""
    tokens = re.split(r"([\x09-\x0D\x20]+)", text)
    confirmed = {r["value"] for r in rows if r["is_secret"]}
    for at in {r["word_at"] for r in rows}:
        word, done, out = tokens[2 * at], 0, ""
        for r in sorted((r for r in rows if r["word_at"] == at), key=lambda r: r["part_at"]):
            begin = word.index(r["value"], done)
            out += word[done:begin] + (mask if r["value"] in confirmed else r["value"])
            done = begin + len(r["value"])
        tokens[2 * at] = out + word[done:]
    return "".join(tokens)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_secrets_are_masked_by_place(spark, model, broadcast_bytes):
    """Longer words that contain a secret's value, white space and all other words stay as they were."""
    short = "abcdef12"
    texts = [
        f"\ttoken={short}  then\r\n{short}3456 and x{short} or token: {short}. End ",
        f'a "secret" = "{HEX}"\n\n{HEX}, {HEX}ff;pwd={short}-- more', f"  api_key={HEX},client_secret={HEX[::-1]}; \x0b {HEX[::-1]}",
        " ".join(f"token={HEX[k % 20:]}{k}," for k in range(300)), ",".join(f"token={HEX}{k}" for k in range(200)) + "\n",
    ]
    docs = documents(spark, list(enumerate(texts)), "secret_places")
    for forest in (model[1], None):
        found = secrets.scan_secrets(docs, model[0], forest, "source").collect()
        out = secrets.redact_secrets(docs, model[0], forest, "source", broadcast_bytes=broadcast_bytes).collect()
        for r in out:
            rows = [f for f in found if f["doc_id"] == r["doc_id"]]
            assert r["text"] == masked_plainly(texts[r["doc_id"]], rows) and "[SECRET]" in r["text"]
            assert "[SECRET]3456" not in r["text"]


def test_redaction_of_many_secrets_in_one_text(spark, model):
    text = " ".join(f"token={k:06d}{HEX}" for k in range(16000))
    (row,) = secrets.redact_secrets(documents(spark, [(1, text)]), *model).collect()
    assert row["text"] == " ".join(["token=[SECRET]"] * 16000)


def test_places_beyond_the_bound_are_not_broadcast(spark):
    docs = documents(spark, [(k, f'password = "x{k}y{k}z{k}w{k}"') for k in range(20)])
    words = secrets.store(spark.createDataFrame([("word",)], "entry string"), "words")
    out = secrets.redact_secrets(docs, words, None, broadcast_bytes=0)
    assert "BroadcastHashJoin" not in plan_of(out)
    assert all(secrets.MASK in r["text"] for r in out.collect())
