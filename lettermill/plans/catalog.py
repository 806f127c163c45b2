"""Every named query: a function of the session and the table folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions import extract
from lettermill.functions.dates import MONTHS, display_date, mail_date_to_iso
from lettermill.functions.html import html_text, html_text_parsed
from lettermill.functions.scoring import id_label, label_id, top_label
from lettermill.functions.text import first_words, pin, text_array
from lettermill.models.backends import label_by_scores
from lettermill.models.bayes import apply_bayes, save_bayes, train_bayes
from lettermill.operators import audit, deadletter, display, events, metrics, phrases, select
from lettermill.operators.classify import category_counts, classify
from lettermill.operators.enrich import enrich
from lettermill.plans.mails import INGESTED_AT, late_mails, mails, published, records, table
from lettermill.session import state_session, work_dir
from lettermill.sinks import commits, files
from lettermill.sources.mailboxes import decode_messages, normalise_messages
from lettermill.sources.topics import stream_topic_files, write_topic_files
from lettermill.streaming.ordered import order_stream
from lettermill.streaming.pipeline import (
    Pipeline,
    dedup_stream,
    drain,
    events_table,
    read_dead_letters,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MAIL = {"subject": "subject", "body": "body", "sender": "sender"}
ENRICHED = ["company_name", "role_title", "rejection_type", "job_board", "confidence"]
ASOF = dt.date(2024, 1, 11)
# Within the mail's days, so that the cutoff ten days before leaves some out.
MAILBOX_ASOF = dt.datetime(2024, 1, 11, 1)
MAILBOX_ROWS = 100
LATEST_ROWS = 100
OVERSIZE_BYTES = 4096
LABEL_WORDS = 400


def query(function: Query) -> Query:
    """Register a query under its function's name, without the ending that keeps names apart."""
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def _one_decimal(df: DataFrame, column: str = "confidence") -> DataFrame:
    """32-bit scores as the one-decimal numbers they stand for."""
    return df.withColumn(column, F.round(F.col(column).cast("double"), 1))


def _mail_text(chars: int | None = None):
    return extract.mail_text(F.col("subject"), F.col("body"), chars)


# --- gate --------------------------------------------------------------------
@query
def classify_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(mails(spark, sf_dir)).select("doc_id", "category")


@query
def classify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(mails(spark, sf_dir), with_scores=True).select(
        "doc_id", "has_context", "strong_rejection", "strong_application", "rejection_score",
        "application_score", "category",
    )


@query
def classify_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character is searched, of mail whose phrase stands at the end."""
    return classify(late_mails(spark, sf_dir)).select("doc_id", "category")


@query
def classify_gate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mail through a reading window."""
    windowed = classify(late_mails(spark, sf_dir), body_chars=rules.GATE_BODY_CHARS)
    return windowed.select("doc_id", "category")


@query
def category_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_counts(classify(mails(spark, sf_dir)))


# --- extraction --------------------------------------------------------------
@query
def role_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id", extract.role_title(_mail_text()).alias("role_title")
    )


@query
def role_title_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id", extract.role_title(_mail_text(None)).alias("role_title")
    )


@query
def rejection_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mails(spark, sf_dir).select("doc_id", _mail_text().alias("text"))
    return texts.select("doc_id", extract.rejection_type(F.col("text")).alias("rejection_type"))


@query
def rejection_type_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mails(spark, sf_dir).select("doc_id", _mail_text(None).alias("text"))
    return texts.select("doc_id", extract.rejection_type(F.col("text")).alias("rejection_type"))


@query
def company_from_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id", extract.sender_company(F.col("sender")).alias("company_name")
    )


@query
def job_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select(
        "doc_id", extract.job_board(F.col("sender")).alias("job_board")
    )


@query
def job_board_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = extract.job_board(F.col("sender"), rules.INGEST_JOB_BOARDS)
    return mails(spark, sf_dir).select("doc_id", board.alias("job_board"))


def _board_table(spark: SparkSession) -> DataFrame:
    rows = [(i, keyword, board) for i, (keyword, board) in enumerate(rules.JOB_BOARDS)]
    return spark.createDataFrame(rows, "priority int, keyword string, value string")


@query
def job_board_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board from a rule table instead of a rule list."""
    return phrases.with_first_rule(
        mails(spark, sf_dir).select("doc_id", "sender"),
        _board_table(spark), F.col("sender"), rules.DEFAULT_BOARD,
    ).select("doc_id", "job_board")


@query
def job_board_join_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the salted join that serves rule tables of any size."""
    return phrases.with_first_rule(
        mails(spark, sf_dir).select("doc_id", "sender"),
        _board_table(spark), F.col("sender"), rules.DEFAULT_BOARD, small_rows=0,
        broadcast_rows=0,
    ).select("doc_id", "job_board")


def _sender_gazetteer(all_mails: DataFrame) -> DataFrame:
    """Companies that send mail, and the two the texts name."""
    names = pin(all_mails.select("sender"), "name", extract.sender_company(F.col("sender")))
    named = F.explode(text_array(["Northwind", "Contoso"])).alias("name")
    return names.filter(F.col("name") != "").select("name").distinct().union(
        all_mails.sparkSession.range(1).select(named)
    )


def _with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_mails = mails(spark, sf_dir).drop("is_read")
    return phrases.with_candidates(
        all_mails, _sender_gazetteer(all_mails), _mail_text()
    )


@query
def company_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_candidates(spark, sf_dir).select(
        "doc_id", F.array_join("org_candidates", "|").alias("candidates")
    )


def _benchmark_candidates(spark: SparkSession, sf_dir: str, **bounds: int) -> DataFrame:
    """The benchmark's longer capitalised words, looked up in whole texts."""
    words = F.split(phrases.plain_words(F.col("text")), " ")
    capitalised = F.filter(words, lambda w: w.rlike(r"^\p{Lu}\p{L}{4,}$"))
    names = table(spark, sf_dir, "benchmark").select(F.explode_outer(capitalised).alias("name"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrases.with_candidates(
        texts, names, F.col("text"), small_rows=0, **bounds
    ).select("doc_id", F.array_join("org_candidates", "|").alias("candidates"))


@query
def company_candidates_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer too long for literals: a broadcast join if it is within bounds."""
    return _benchmark_candidates(spark, sf_dir)


@query
def company_candidates_join_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the salted join that serves gazetteers of any size."""
    return _benchmark_candidates(spark, sf_dir, broadcast_rows=0)


@query
def entity_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable candidate, else the sender's company."""
    named = F.nullif(extract.first_entity(F.col("org_candidates")), F.lit(""))
    return _with_candidates(spark, sf_dir).select(
        "doc_id",
        F.coalesce(named, extract.sender_company(F.col("sender"))).alias("company_name"),
    )


# --- enrichment --------------------------------------------------------------
@query
def enrich_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_decimal(
        enrich(mails(spark, sf_dir), "rejection", **MAIL).select("doc_id", *ENRICHED)
    )


@query
def enrich_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_decimal(
        enrich(mails(spark, sf_dir), "application", **MAIL).select("doc_id", *ENRICHED)
    )


@query
def enrich_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_decimal(
        enrich(late_mails(spark, sf_dir), "rejection", **MAIL).select("doc_id", *ENRICHED)
    )


@query
def enrich_rejections_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mail through a reading window."""
    windowed = enrich(
        late_mails(spark, sf_dir), "rejection", body_chars=rules.ENRICH_BODY_CHARS, **MAIL
    )
    return _one_decimal(windowed.select("doc_id", *ENRICHED))


@query
def enrich_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_decimal(
        enrich(
            _with_candidates(spark, sf_dir), "rejection", candidates="org_candidates", **MAIL
        ).select("doc_id", *ENRICHED)
    )


# --- events, routing, dead letters -------------------------------------------
@query
def events_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as published: topic, key, JSON value and headers."""
    out = events.to_envelopes(published(mails(spark, sf_dir)))
    headers = F.array_join(
        F.transform(
            "headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))
        ),
        ";",
    )
    return out.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        headers.alias("headers"),
    )


@query
def route_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = events.route(classify(mails(spark, sf_dir)))
    return routed.groupBy("topic", "source").agg(F.count(F.lit(1)).alias("mails"))


def _parsed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return deadletter.parse_payloads(records(mails(spark, sf_dir)), **options)


@query
def json_parse_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.good_events(_parsed(spark, sf_dir))


@query
def dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.lit("2024-06-01T00:00:00+00:00")
    return deadletter.dead_letters(_parsed(spark, sf_dir), "replay-test", stamp)


@query
def dlq_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.audit(deadletter.dead_letters(_parsed(spark, sf_dir), "audit"))


@query
def dlq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversize letters read again under a larger limit are good events."""
    parsed = _parsed(spark, sf_dir, max_bytes=OVERSIZE_BYTES)
    letters = deadletter.dead_letters(parsed, "replay")
    again = deadletter.replay(letters, reasons=[deadletter.OVERSIZE])
    return deadletter.good_events(deadletter.parse_payloads(again)).select(
        "topic", "event_id", "source", "raw_subject", "raw_body_text"
    )


@query
def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir, max_bytes=OVERSIZE_BYTES)
    return parsed.select(
        "offset", F.coalesce("failure_reason", F.lit("good")).alias("state")
    )


@query
def publish_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records too long for the broker, as the dead letters that take their place."""
    checked = deadletter.refused(events.to_envelopes(published(mails(spark, sf_dir))), OVERSIZE_BYTES)
    away = checked.filter(F.col("refusal").isNotNull())
    return deadletter.to_dead_letters(
        away, F.col("topic"), F.col("refusal"), F.col("value").cast("string"), "ingest", F.lit(INGESTED_AT)
    )


# --- choosing rows -------------------------------------------------------------
def _mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).withColumnRenamed("doc_id", "uid")


@query
def mailbox_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = select.recent_unread(_mailbox(spark, sf_dir), MAILBOX_ASOF, cap=MAILBOX_ROWS)
    return newest.select("uid", "source", "subject", "received_at")


@query
def mailbox_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.oldest_unread(
        _mailbox(spark, sf_dir), columns=["uid", "subject", "sender", "received_at", "body"]
    )


@query
def mailbox_recent_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 unread mails of every mailbox at once."""
    unread = _mailbox(spark, sf_dir).filter(~F.col("is_read"))
    return select.top_per_group(
        unread.select("uid", "source", "received_at"), ["source"], [F.desc("uid")], 100, "uid"
    )


@query
def unseen_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail whose document carries no quality label yet: the labelled ones were consumed."""
    processed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"))
    return select.unseen(_mailbox(spark, sf_dir), processed).select("uid", "source", "subject")


@query
def missing_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic specifications without any routed mail so far."""
    specs = spark.createDataFrame(
        rules.TOPIC_SPECS, "name string, partitions int, replication int, retention_days int"
    )
    existing = events.route(classify(mails(spark, sf_dir))).select(F.col("topic").alias("name"))
    return select.missing_specs(specs, existing)


@query
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = text_array([spec[0] for spec in rules.TOPIC_SPECS])
    stamped = table(spark, sf_dir, "events").select(
        "event_id",
        F.element_at(topics, (F.col("event_id") % len(rules.TOPIC_SPECS) + 1).cast("int")).alias(
            "topic"
        ),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("day"),
    )
    return select.retain_by_topic(stamped, "day", ASOF)


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered one to three times."""
    return mails(spark, sf_dir).select(
        "doc_id",
        events.content_id(
            *[F.col(c) for c in ("source", "subject", "sender", "received_at", "body")]
        ).alias("event_id"),
        "received_at",
        F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("attempt"),
    )


@query
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_delivery(
        _deliveries(spark, sf_dir), order=("received_at", "doc_id", "attempt")
    )


@query
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = work_dir(spark, "published")
    published(mails(spark, sf_dir)).select("event_id", "source", "received_at").write.parquet(stored)
    out = spark.read.schema("event_id string, source string, received_at string").parquet(stored)
    ordered = events.order_by_source(out, "received_at", "event_id").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    )
    written = work_dir(spark, "ordered")
    ordered.write.parquet(written)
    rows = spark.read.schema(ordered.schema).parquet(written)
    # The place in the source's order as written, from a few counts for each partition.
    parts = rows.groupBy("source", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part")
    parts = parts.select("source", "part", "first", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(parts), ["source", "part"]).select(
        "event_id", "source", "received_at", (F.col("before") + F.col("at") - F.col("first") + 1).alias("position")
    )


# --- display -------------------------------------------------------------------
def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All published events enriched in one pass, with their kind."""
    kind = F.when(F.col("topic") == rules.TOPIC_REJECTIONS, "rejection").otherwise("application")
    return enrich(published(mails(spark, sf_dir)).withColumn("event_type", kind), F.col("event_type"))


@query
def sheet_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.rejection_rows(_enriched(spark, sf_dir).filter("event_type = 'rejection'"))


@query
def sheet_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.application_rows(_enriched(spark, sf_dir).filter("event_type = 'application'"))


@query
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest summary rows."""
    rows = display.rejection_rows(_enriched(spark, sf_dir).filter("event_type = 'rejection'"))
    return select.latest(rows, LATEST_ROWS, F.desc("date_received"), F.asc("event_id"))


# --- metrics -------------------------------------------------------------------
def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select(
        F.lit(0).cast("long").alias("batch_id"), F.lit("rules").alias("backend"), "event_type",
        *ENRICHED,
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.batch_metrics(_keyed(spark, sf_dir), latency_seconds=F.lit(2.5))
    return _rounded(
        out, "avg_confidence", "min_confidence", "max_confidence", "company_extraction_rate",
        "role_extraction_rate", "throughput_events_per_sec",
    )


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.label_distribution(_keyed(spark, sf_dir)), "label_pct")


@query
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, sf_dir)
    return _rounded(
        metrics.metric_rows(metrics.batch_metrics(keyed), metrics.label_distribution(keyed)),
        "value",
    )


@query
def backend_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' confidence and the scored label's score on the same mail, in one pass."""
    enriched = enrich(mails(spark, sf_dir), "rejection", **MAIL)
    texts = enriched.withColumn("text", _mail_text())
    scored = label_by_scores(score="scored_score")(texts, "text", "scored_label")
    per_backend = scored.select(
        F.inline(
            F.array(
                F.struct(F.lit("rules").alias("backend"), F.col("confidence").cast("double").alias("confidence")),
                F.struct(F.lit("scored").alias("backend"), F.col("scored_score").alias("confidence")),
            )
        )
    )
    return _rounded(metrics.backend_comparison(per_backend), "avg_confidence")


@query
def output_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.output_summary(_enriched(spark, sf_dir))


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per second of each event type over the time it spans."""
    epoch = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))")
    spans = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        (F.max(epoch) - F.min(epoch)).cast("double").alias("seconds"),
    )
    return _rounded(
        spans.withColumn(
            "events_per_sec", metrics.throughput(F.col("events"), F.col("seconds"))
        ),
        "events_per_sec",
    )


# --- labels --------------------------------------------------------------------
@query
def label_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest of all dimensions, unknown below the threshold."""
    vectors = table(spark, sf_dir, "embeddings")
    names = F.transform(
        F.sequence(F.lit(1), F.size("embedding")), lambda i: F.concat(F.lit("dim_"), i.cast("string"))
    )
    return vectors.select(
        "vec_id", top_label(names, F.col("embedding"), 0.25).alias("top_label")
    )


@query
def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mails(spark, sf_dir).select("doc_id", _mail_text(None).alias("text"))
    return label_by_scores()(texts, "text", "label").drop("text")


@query
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mails(spark, sf_dir).select("doc_id", _mail_text().alias("text"))
    labelled = texts.select("doc_id", extract.rejection_type(F.col("text")).alias("label"))
    encoded = labelled.select("doc_id", "label", label_id(F.col("label")).alias("label_id"))
    return encoded.withColumn("decoded", id_label(F.col("label_id")))


@query
def first_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", first_words(F.col("text"), LABEL_WORDS).alias("words")
    )


@query
def text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the words of mail labelled by the rules, save, load, and label all mail."""
    texts = mails(spark, sf_dir).select("doc_id", _mail_text(None).alias("text"))
    labelled = pin(texts, "label", extract.rejection_type(F.col("text")))
    model = save_bayes(train_bayes(labelled), work_dir(spark, "model"))
    scored = apply_bayes(model, texts)
    return scored.select("doc_id", "label", F.round("score", 4).alias("score"))


# --- dates, messages, HTML -------------------------------------------------------
@query
def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header dates in several spellings to ISO."""
    ts, uid = F.col("ts"), F.col("event_id")
    month = F.element_at(text_array([m.capitalize() for m in MONTHS]), F.month(ts))
    clock = F.substring(ts.cast("string"), 12, 8)
    date = F.concat_ws(" ", F.day(ts).cast("string"), month, F.year(ts).cast("string"), clock)
    header = (
        F.when(uid % 7 == 0, F.concat(F.lit("Sun, "), date, F.lit(" +0200 (CEST)")))
        .when(uid % 7 == 1, F.concat(date, F.lit(" -0730")))
        .when(uid % 7 == 2, F.concat(F.lit("Mon, "), date, F.lit(" GMT")))
        .when(uid % 7 == 3, F.concat(date, F.lit(" EST")))
        .when(uid % 7 == 4, F.concat(date, F.lit(" -0000")))
        .when(uid % 7 == 5, date)
        .otherwise(F.concat(F.lit("not a date "), uid.cast("string")))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", mail_date_to_iso(header).alias("received_at")
    )


@query
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO dates with several offsets as UTC display text."""
    uid = F.col("event_id")
    iso = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    offset = F.element_at(text_array(["+02:00", "Z", "-07:30", ""]), (uid % 4 + 1).cast("int"))
    text = F.when(uid % 9 == 8, F.lit("not a date")).otherwise(F.concat(iso, offset))
    return table(spark, sf_dir, "events").select("event_id", display_date(text).alias("shown"))


@query
def mail_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and their addresses as nested messages, flattened again."""
    uid = F.col("page_id")
    sender = F.struct(F.struct(F.col("url").alias("address")).alias("emailAddress"))
    messages = table(spark, sf_dir, "pages").select(
        uid.cast("string").alias("id"),
        F.when(uid % 4 != 0, F.concat(F.lit("Page "), uid.cast("string"))).alias("subject"),
        F.when(uid % 5 != 0, sender).alias("from"),
        F.lit("2024-01-01T00:00:00Z").alias("receivedDateTime"),
        F.struct(
            F.when(uid % 3 == 0, "text").otherwise("HTML").alias("contentType"),
            F.col("html").alias("content"),
        ).alias("body"),
    )
    return normalise_messages(messages)


@query
def html_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query
def html_text_parsed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text nodes, script and style text included."""
    return table(spark, sf_dir, "pages").select(
        "page_id", html_text_parsed(F.col("html")).alias("text")
    )


def _raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail as an RFC 822 message: plain, HTML, mixed with an attachment, UTF-16."""
    uid, body = F.col("doc_id"), F.col("body")
    line = "\r\n"
    day = F.to_date(F.substring("received_at", 1, 10))
    month = F.element_at(text_array([m.capitalize() for m in MONTHS]), F.month(day))
    date = F.concat_ws(
        " ", F.day(day).cast("string"), month, F.year(day).cast("string"),
        F.substring("received_at", 12, 8), F.lit("+0000"),
    )
    head = F.concat(
        F.lit("From: "), F.col("sender"), F.lit(line),
        F.lit("Subject: =?UTF-8?B?"), F.base64(F.encode("subject", "UTF-8")), F.lit("?=" + line),
        F.lit("Date: "), date, F.lit(line + "MIME-Version: 1.0" + line),
    )

    def part(content_type: str, charset: str, text, extra: str = "") -> Column:
        return F.concat(
            F.lit(f"Content-Type: {content_type}; charset={charset}{line}{extra}"
                  f"Content-Transfer-Encoding: base64{line}{line}"),
            F.base64(F.encode(text, charset.upper())),
            F.lit(line),
        )

    escaped = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><style>p{}</style><body><p>"), escaped, F.lit("</p></body></html>"))
    plain = part("text/plain", "utf-8", body)
    cut, end = F.lit(f"--cut{line}"), F.lit(f"--cut--{line}")
    mixed = F.concat(
        F.lit(f"Content-Type: multipart/mixed; boundary=cut{line}{line}"),
        cut, part("text/html", "utf-8", html),
        cut, plain,
        cut, part("text/plain", "utf-8", F.col("sender"), f"Content-Disposition: attachment{line}"),
        end,
    )
    content = (
        F.when(uid % 4 == 0, plain)
        .when(uid % 4 == 1, part("text/html", "utf-8", html))
        .when(uid % 4 == 2, mixed)
        .otherwise(part("text/plain", "utf-16le", body))
    )
    return mails(spark, sf_dir).select(
        "doc_id", F.concat(head, content).cast("binary").alias("content")
    )


@query
def mime_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_messages(_raw_messages(spark, sf_dir), F.col("doc_id"))
    return decoded.select("uid", "subject", "sender", "received_at", "body", "error")


# --- streams -------------------------------------------------------------------
STREAM_STAMP = "2024-06-01T00:00:00+00:00"


def _drained(spark: SparkSession, sf_dir: str, second_sink=None) -> str:
    """Publish the records to topic files, drain both topics, return the output folder."""
    topics = work_dir(spark, "topics")
    out_dir = work_dir(spark, "out")
    write_topic_files(records(mails(spark, sf_dir)), topics)
    streams = {
        topic: stream_topic_files(spark, topics, topic)
        for topic in (rules.TOPIC_REJECTIONS, rules.TOPIC_APPLICATIONS)
    }
    pipeline = Pipeline(
        out_dir, processed_at=STREAM_STAMP, producer_name="stream", second_sink=second_sink
    )
    drain(spark, pipeline, streams, work_dir(spark, "checkpoint"))
    return out_dir


def _json_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    kinds = [
        files.read_json_lines(spark, out_dir, kind)
        .drop("run_id", "batch_id")
        .withColumn("event_type", F.lit(kind))
        for kind in files.FOLDERS
    ]
    return _one_decimal(kinds[0].unionByName(kinds[1]), "nlp_confidence")


@query
def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both topics through the streaming job; the JSON lines it wrote."""
    return _json_lines(spark, _drained(spark, sf_dir))


@query
def stream_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the records under one checkpoint, the others under a new one, into one folder."""
    out_dir = work_dir(spark, "out")
    for half in (0, 1):
        topics = work_dir(spark, "topics")
        write_topic_files(records(mails(spark, sf_dir)).filter(F.col("offset") % 2 == half), topics)
        streams = {
            topic: stream_topic_files(spark, topics, topic)
            for topic in (rules.TOPIC_REJECTIONS, rules.TOPIC_APPLICATIONS)
        }
        pipeline = Pipeline(out_dir, processed_at=STREAM_STAMP, producer_name="stream")
        drain(spark, pipeline, streams, work_dir(spark, "checkpoint"))
    return _json_lines(spark, out_dir)


@query
def stream_backfill_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records live, and all again as a backfill under a new checkpoint: merged by id, none is doubled."""
    topics, events_dir = work_dir(spark, "topics"), work_dir(spark, "events")
    write_topic_files(records(mails(spark, sf_dir)), topics)
    for _ in range(2):
        streams = {
            topic: stream_topic_files(spark, topics, topic)
            for topic in (rules.TOPIC_REJECTIONS, rules.TOPIC_APPLICATIONS)
        }
        pipeline = Pipeline(
            work_dir(spark, "out"), processed_at=STREAM_STAMP, producer_name="stream", events_dir=events_dir, buckets=8
        )
        drain(spark, pipeline, streams, work_dir(spark, "checkpoint"))
    kinds = [
        events_table(spark, events_dir, kind, 8).read().withColumn("event_type", F.lit(kind)) for kind in files.FOLDERS
    ]
    return _one_decimal(kinds[0].unionByName(kinds[1]), "nlp_confidence")


@query
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and dead letters written by kind, from the log of commits alone."""
    return commits.committed_counts(spark, _drained(spark, sf_dir)).select("event_type", "rows", "dead_letters")


@query
def stream_short_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets missing inside what a batch read, from the ranges in the log of commits."""
    found = audit.short_ranges(commits.read_ranges(spark, _drained(spark, sf_dir)))
    return found.select("topic", "partition", "first", "last", "records", "missing")


@query
def offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lost offsets of a topic in four partitions, at their ends too."""
    place = F.col("event_id")
    kept = table(spark, sf_dir, "events").select(
        F.lit("events").alias("topic"), (place % 4).cast("int").alias("partition"), F.floor(place / 4).alias("offset")
    )
    lost = (F.col("offset") % 250).between(40, 44) | ((F.col("partition") == 2) & F.col("offset").between(300, 420))
    bounds = kept.groupBy("topic", "partition").agg((F.min("offset") - 3).alias("first"), (F.max("offset") + 2).alias("last"))
    return audit.offset_gaps(kept.filter(~lost), bounds, slice_offsets=512)


@query
def stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in any order, released source by source in the order of their time.

    A last event moves the watermark past all others; what comes after that is late and left out.
    """
    arrivals, out_dir, checkpoint = (work_dir(spark, n) for n in ("arrivals", "ordered", "checkpoint"))
    schema = "event_id string, source string, received_at string"
    events_ = published(mails(spark, sf_dir)).select("event_id", "source", "received_at")
    last = spark.createDataFrame([("last", None, "2099-01-01T00:00:00+00:00")], schema)
    late = spark.createDataFrame([("late", "gmail", "2024-01-01T00:00:00+00:00")], schema)
    session = state_session(spark)
    for part in (events_.repartition(4, F.xxhash64("event_id")), last, late):
        part.write.mode("append").parquet(arrivals)
        stream = session.readStream.schema(schema).parquet(arrivals)
        (
            order_stream(stream, span="6 hours")
            .writeStream.format("parquet")
            .option("path", out_dir)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    rows = spark.read.schema(f"{schema}, position string").parquet(out_dir)
    place = F.row_number().over(Window.partitionBy("source").orderBy("position"))
    return rows.select("event_id", "source", "received_at", place.alias("position"))


@query
def stream_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet tables a second sink wrote beside the JSON lines."""
    out_dir = work_dir(spark, "sheets")
    _drained(spark, sf_dir, files.sheet_sink(out_dir))
    tables = []
    for kind, folder in files.FOLDERS.items():
        sheet = spark.read.parquet(f"{out_dir}/{folder}/sheet").drop("run_id", "batch_id")
        names = {title: title.lower().replace(" ", "_") for title in sheet.columns}
        tables.append(sheet.withColumnsRenamed(names).withColumn("tab", F.lit(kind)))
    return tables[0].unionByName(tables[1], allowMissingColumns=True)


@query
def stream_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_dead_letters(spark, _drained(spark, sf_dir)).drop("run_id", "batch_id", "event_type")


@query
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by the metrics sink, over all batches of a topic."""
    rows = spark.read.parquet(f"{_drained(spark, sf_dir)}/metrics")
    return (
        rows.filter("key = 'batch_size'")
        .groupBy("event_type", "backend")
        .agg(F.sum("value").alias("events"))
    )


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated deliveries through the deduplicating stream: some without an id, one dated far ahead."""
    topics, out_dir = work_dir(spark, "deliveries"), work_dir(spark, "deduplicated")
    schema = "event_id string, received_at string, ingested_at string, offset long"
    (
        _deliveries(spark, sf_dir)
        .select(
            F.when(F.col("doc_id") % 50 != 0, F.col("event_id")).alias("event_id"),
            F.when(F.col("doc_id") == 1, "2099-01-01T00:00:00+00:00").otherwise(F.col("received_at")).alias("received_at"),
            F.col("received_at").alias("ingested_at"),
            (F.col("doc_id") * 3 + F.col("attempt")).alias("offset"),
        )
        .write.parquet(topics)
    )
    deliveries = state_session(spark).readStream.schema(schema).parquet(topics)
    started = (
        dedup_stream(deliveries, "2 hours", spread=F.col("offset"))
        .select("event_id")
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema("event_id string").parquet(out_dir)
