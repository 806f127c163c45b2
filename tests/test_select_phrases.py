from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.operators import phrases, select
from lettermill.sources.mailboxes import mark_processed, read_processed_ids
from tests.conftest import plan_of

ASOF = dt.date(2025, 6, 20)


def mailbox(spark):
    rows = [
        (i, i % 3 == 0, f"2025-06-{1 + i % 20:02d}T00:00:00Z", f"s{i}") for i in range(100)
    ]
    return spark.createDataFrame(rows, "uid int, is_read boolean, received_at string, subject string")


def test_recent_unread(spark):
    rows = select.recent_unread(mailbox(spark), ASOF, cap=20).collect()
    expected = [i for i in range(100) if i % 3 and 1 + i % 20 >= 10][-20:]
    assert [r["uid"] for r in rows] == expected


def test_oldest_unread(spark):
    rows = select.oldest_unread(mailbox(spark), 5, columns=["uid", "received_at"]).collect()
    assert [r["uid"] for r in rows] == [20, 40, 80, 1, 41]
    assert "TakeOrderedAndProject" in plan_of(select.oldest_unread(mailbox(spark)))


def test_mail_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "mail")
    mailbox(spark).write.parquet(path)
    plan = plan_of(select.recent_unread(spark.read.parquet(path), ASOF).select("uid", "subject"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(recei" in pushed


def test_processed_ids(spark, tmp_path):
    path = str(tmp_path / "processed")
    mails = mailbox(spark).withColumn("uid", F.col("uid").cast("string"))
    assert select.unseen(mails, read_processed_ids(spark, path)).count() == 100
    mark_processed(mails.filter("uid < '5'"), path, 0)
    mark_processed(mails.filter("uid < '5'"), path, 0)
    left = select.unseen(mails, read_processed_ids(spark, path))
    assert left.count() == mails.filter("uid >= '5'").count()
    assert read_processed_ids(spark, path).count() == mails.filter("uid < '5'").count()


def test_missing_specs(spark):
    specs = spark.createDataFrame([("a",), ("b",)], "name string")
    existing = spark.createDataFrame([("b",), ("b",), ("c",)], "name string")
    assert [r["name"] for r in select.missing_specs(specs, existing).collect()] == ["a"]


def test_top_per_group_with_a_busy_group(spark):
    rows = [("busy" if i % 10 else f"g{i % 7}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int")
    top = select.top_per_group(df, ["k"], [F.desc("v")], 30, "v", salts=8)
    found = {}
    for r in top.collect():
        found.setdefault(r["k"], []).append(r["v"])
    for key in {k for k, _ in rows}:
        assert sorted(found[key], reverse=True) == sorted((v for k, v in rows if k == key), reverse=True)[:30]
    assert plan_of(top).count("WindowGroupLimit") >= 2


def test_first_delivery(spark):
    rows = [("a", 3), ("a", 1), ("b", 2), *[("hot", i) for i in range(100, 2000)]]
    df = spark.createDataFrame(rows, "event_id string, received_at int")
    out = select.first_delivery(df)
    assert sorted((r[0], r[1]) for r in out.collect()) == [("a", 1), ("b", 2), ("hot", 100)]
    assert "Partial" in plan_of(out)


def test_retention(spark, tmp_path):
    days = [(f"2025-06-{d:02d}", t) for d in (1, 12, 13, 20) for t in (rules.TOPIC_REJECTIONS, rules.TOPIC_DLQ_REJECTIONS, "x")]
    df = spark.createDataFrame(days, "day string, topic string")
    kept = {tuple(r) for r in select.retain_by_topic(df, "day", ASOF).collect()}
    assert kept == {d for d in days if d[1] != rules.TOPIC_REJECTIONS or d[0] >= "2025-06-13"}
    path = str(tmp_path / "t")
    df.write.partitionBy("day").parquet(path)
    part = spark.read.schema("topic string, day string").parquet(path)
    plan = plan_of(select.retain(part, "day", 7, ASOF))
    assert re.search(r"PartitionFilters: \[[^\]]*>= 2025-06-13", plan)
    assert select.retain(part, "day", 7, ASOF).count() == 6


def test_latest(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "v int")
    assert [r[0] for r in select.latest(df, 3, F.desc("v")).collect()] == [49, 48, 47]


NAMES = ["Acme", "Acme Corp", "Blue Sky Inc.", "O'Neil", "the", "Zürich AG"]


# Literals, broadcast join, salted join.
WAYS = [(500, 0), (0, 1000), (0, 0)]


def candidate_rows(spark, small_rows, broadcast_rows, names=NAMES):
    rng = random.Random(7)
    words = ["Acme", "Corp", "Blue", "Sky", "Inc", "O", "Neil", "the", "Zürich", "AG", "x", "Acmes"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", ".", "'"]) for _ in range(12))) for i in range(200)]
    texts += [(900, ""), (901, None), (902, "Acme " * 50)]
    df = spark.createDataFrame(texts, "i int, t string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    out = phrases.with_candidates(df, table, F.col("t"), small_rows=small_rows, broadcast_rows=broadcast_rows)
    return dict(texts), {r["i"]: r["org_candidates"] for r in out.collect()}


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", text or ""))


def brute_candidates(text, names=NAMES):
    padded = f" {plain(text)} "
    found = [
        (padded.index(f" {plain(n)} "), -len(plain(n)), n) for n in names if f" {plain(n)} " in padded
    ]
    return [n for _, _, n in sorted(found)]


@pytest.mark.parametrize("way", WAYS)
def test_candidates_equal_brute_force(spark, way):
    texts, found = candidate_rows(spark, *way)
    assert found == {i: brute_candidates(t) for i, t in texts.items()}


@pytest.mark.parametrize("way", WAYS)
def test_empty_gazetteer(spark, way):
    _, found = candidate_rows(spark, *way, names=["--"])
    assert set(map(tuple, found.values())) == {()}


def test_joins_by_size(spark):
    df = spark.createDataFrame([(1, "Acme")], "i int, t string")
    table = spark.createDataFrame([("Acme",), ("Blue",)], "name string")

    def plan(broadcast_rows):
        return plan_of(
            phrases.with_candidates(df, table, F.col("t"), small_rows=0, broadcast_rows=broadcast_rows)
        )

    for rows in (0, 1, 2):
        assert "CartesianProduct" not in plan(rows) and "NestedLoop" not in plan(rows)
    assert "BroadcastHashJoin [__anchor" in plan(2)
    # One row over the bound: shuffled and salted.
    assert "SortMergeJoin [__anchor" in plan(1) and "__salt" in plan(1)


def test_long_entries_are_not_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([("Acme", "A long name")], "words string, name string")
    sizes = phrases._sizes(table, "words", "name", F.length("words"))
    assert sizes["bytes"] == 15 and sizes["longest"] == 4
    assert phrases._fits(sizes, 10) and not phrases._fits(sizes, 0)
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", 14)
    assert not phrases._fits(sizes, 10)


@pytest.mark.parametrize("way", WAYS)
def test_all_forms_give_one_answer_for_repeated_and_missing_ids(spark, way):
    rows = [(1, "A B"), (1, "Zed Co"), (None, "Zed Co a b"), (None, None), (2, "A-B A B")]
    df = spark.createDataFrame(rows, "i int, t string")
    names = spark.createDataFrame([("A B",), ("A-B",), ("Zed Co",), ("A",), (None,)], "name string")
    out = phrases.with_candidates(df, names, F.col("t"), small_rows=way[0], broadcast_rows=way[1])
    found = sorted(((r["i"], r["t"], r["org_candidates"]) for r in out.collect()), key=repr)
    both = ["A B", "A-B", "A"]
    assert found == sorted(
        [(1, "A B", both), (1, "Zed Co", ["Zed Co"]), (None, "Zed Co a b", ["Zed Co"]), (None, None, []), (2, "A-B A B", both)],
        key=repr,
    )


@pytest.mark.parametrize("way", WAYS)
def test_first_rule_of_a_table(spark, way):
    rows = [(2, "ab", "second"), (1, "abcd", "first"), (3, "zz top", "third"), (0, "", "never"), (9, "q", "one letter")]
    table = spark.createDataFrame(rows, "priority int, keyword string, value string")
    texts = ["xABx", "abcde", "a", "", None, "a zz top b", "zz abcd", "qqq" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = phrases.with_first_rule(df, table, F.col("t"), "none", *way)
    assert [r["job_board"] for r in out.orderBy("i").collect()] == [
        "second", "first", "none", "none", "none", "third", "first", "one letter",
    ]
    none = phrases.with_first_rule(df, table.limit(0), F.col("t"), "none", *way)
    assert {r["job_board"] for r in none.collect()} == {"none"}


@pytest.mark.parametrize("way", WAYS[1:])
def test_first_rule_in_long_texts(spark, way):
    """Keywords of all lengths across the ends of blocks, and texts of a megabyte."""
    rng = random.Random(3)
    rows = [(9, "q"), (8, "zü"), (7, "ab9c"), (6, "Never" * 5), (5, "x" * 70), (4, "long keyword with 日本 in it"), (3, "\U0001f600mid")]
    rows = [(p, k.lower(), f"v{p}") for p, k in rows]
    table = spark.createDataFrame(rows, "priority int, keyword string, value string")
    fill = "".join(rng.choice("abcdefghij \né日") for _ in range(3000))
    texts = [None, "", "Q", fill]
    for at in (0, 500, 505, 511, 512, 690, 700, 1024, 2999):
        texts += [fill[:at] + k.upper() + fill[at:] for _, k, _ in rows if k.upper().lower() == k]
    texts += [fill * 350, fill * 350 + "zü", fill * 200 + rows[5][1] + fill * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = phrases.with_first_rule(df, table, F.col("t"), "none", *way)
    found = {r["i"]: r["job_board"] for r in out.collect()}
    for i, text in enumerate(texts):
        met = [(p, v) for p, k, v in rows if k in (text or "").lower()]
        assert found[i] == (min(met)[1] if met else "none"), i
