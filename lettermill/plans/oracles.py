"""The same results in SQL, for a single-node engine over the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from lettermill import rules, schemas
from lettermill.plans.catalog import (
    ASOF,
    LABEL_WORDS,
    LATEST_ROWS,
    MAILBOX_ASOF,
    MAILBOX_ROWS,
    OVERSIZE_BYTES,
    STREAM_STAMP,
)
from lettermill.plans.mails import BODIES, INGESTED_AT, MINUTES, SENDERS, SUBJECTS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _any(text: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_text(p)})" for p in phrases) + ")"


def _count(text: str, phrases: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_text(p)}) AS INTEGER)" for p in phrases) + ")"


MAILS = f"""mails AS (
  SELECT doc_id,
    CASE WHEN doc_id % 2 = 0 THEN 'gmail' ELSE 'outlook' END AS source,
    {_list(SUBJECTS)}[doc_id % {len(SUBJECTS)} + 1] AS subject,
    {_list(BODIES)}[doc_id * 5 % {len(BODIES)} + 1] || ' ' || text AS body,
    {_list(SENDERS)}[doc_id * 3 % {len(SENDERS)} + 1] AS sender,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id % {MINUTES}), '%Y-%m-%dT%H:%M:%S+00:00')
      AS received_at,
    doc_id % 3 = 0 AS is_read
  FROM documents)"""


_EARLY = f"{_list(BODIES)}[doc_id * 5 % {len(BODIES)} + 1] || ' ' || text AS body"
LATE_MAILS = MAILS.replace(_EARLY, f"text || ' ' || {_list(BODIES)}[doc_id * 5 % {len(BODIES)} + 1] AS body")


def _gate(body: str) -> str:
    """CTEs ``gate_text``, ``gate_scores`` and ``classified``."""
    return f"""gate_text AS (
  SELECT *, lower(subject) AS s, lower(subject) || ' ' || lower({body}) AS t FROM mails),
gate_scores AS (
  SELECT *, {_any('t', rules.JOB_CONTEXT_TERMS)} AS has_context,
    {_any('s', rules.STRONG_REJECTION_SUBJECTS)} AS strong_rejection,
    {_any('s', rules.STRONG_APPLICATION_SUBJECTS)} AS strong_application,
    {_count('t', rules.REJECTION_PHRASES)} AS rejection_score,
    {_count('t', rules.APPLICATION_PHRASES)} AS application_score
  FROM gate_text),
classified AS (
  SELECT *, CASE WHEN NOT has_context THEN 'unrelated'
    WHEN strong_rejection THEN 'rejection'
    WHEN strong_application THEN 'application'
    WHEN rejection_score = 0 AND application_score = 0 THEN 'unrelated'
    WHEN rejection_score >= application_score THEN 'rejection'
    ELSE 'application' END AS category
  FROM gate_scores)"""


GATE = _gate("body")
WINDOW_GATE = _gate(f"left(body, {rules.GATE_BODY_CHARS})")
MAIL_TEXT = "subject || '. ' || body"
WINDOW_MAIL_TEXT = f"subject || '. ' || left(body, {rules.ENRICH_BODY_CHARS})"


def _role(text: str) -> str:
    found = f"regexp_extract({text}, {_text('(?i)' + rules.ROLE_PATTERN)})"
    return f"trim(regexp_replace({found}, '\\s+', ' ', 'g'))"


def _matches(text: str, patterns: Sequence[str]) -> str:
    return f"regexp_matches({text}, {_text('(?i)' + '|'.join(patterns))})"


def _rejection(text: str) -> str:
    return (
        f"CASE WHEN {_matches(text, rules.HARD_REJECTION_PATTERNS)} THEN 'hard_rejection' "
        f"WHEN {_matches(text, rules.SOFT_REJECTION_PATTERNS)} THEN 'soft_rejection' "
        "ELSE 'unknown' END"
    )


def _company(sender: str) -> str:
    domain = f"lower(regexp_extract({sender}, '@([\\w.-]+)', 1))"
    parts = f"string_split({domain}, '.')"
    label = f"CASE WHEN len({parts}) >= 2 THEN {parts}[-2] ELSE {domain} END"
    return (
        f"CASE WHEN {_any(domain, rules.SENDER_DOMAIN_NOISE)} THEN '' "
        f"ELSE upper(left({label}, 1)) || substring({label}, 2) END"
    )


def _board(sender: str, boards: Sequence[tuple[str, str]] = tuple(rules.JOB_BOARDS)) -> str:
    cases = " ".join(
        f"WHEN contains(lower({sender}), {_text(k)}) THEN {_text(v)}" for k, v in boards
    )
    return f"CASE {cases} ELSE '{rules.DEFAULT_BOARD}' END"


def _enriched_from(rows: str, text: str, label: str, company: str | None = None) -> str:
    """CTE ``enriched`` over a relation with subject, body and sender."""
    return f"""found AS (
  SELECT *, {company or _company('sender')} AS company_name, {_role(text)} AS role_title,
    {label} AS rejection_type, {_board('sender')} AS job_board
  FROM {rows}),
enriched AS (
  SELECT *, CAST(round(
      CASE WHEN company_name <> '' THEN 0.4 ELSE 0 END
    + CASE WHEN role_title <> '' THEN 0.4 ELSE 0 END
    + CASE WHEN job_board <> '{rules.DEFAULT_BOARD}' THEN 0.2 ELSE 0 END, 1) AS DOUBLE)
    AS confidence
  FROM found)"""


def _sha(*columns: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(columns) + "))"


EVENT_ID = _sha("source", "subject", "sender", "received_at", "body")
TOPIC = (
    f"CASE category WHEN 'rejection' THEN '{rules.TOPIC_REJECTIONS}' "
    f"ELSE '{rules.TOPIC_APPLICATIONS}' END"
)
ROUTED = f"""routed AS (
  SELECT *, {TOPIC} AS topic, {EVENT_ID} AS event_id,
    CASE WHEN source = 'outlook' THEN {_board('sender', rules.INGEST_JOB_BOARDS)} ELSE '' END
      AS ingest_board
  FROM classified WHERE category <> 'unrelated')"""

ENRICHED = ", ".join(
    [
        MAILS,
        GATE,
        ROUTED,
        _enriched_from(
            "routed",
            MAIL_TEXT,
            f"CASE WHEN category = 'rejection' THEN {_rejection(MAIL_TEXT)} ELSE 'n/a' END",
        ),
    ]
)


def _json(event_id: str) -> str:
    values = {
        "event_id": event_id,
        "source": "source",
        "raw_subject": "subject",
        "raw_body_text": "body",
        "sender_email": "sender",
        "received_at": "received_at",
        "ingested_at": _text(INGESTED_AT),
        "schema_version": _text(rules.SCHEMA_VERSION),
        "company_name": "''",
        "role_title": "''",
        "rejection_type": "'unknown'",
        "job_board": "ingest_board",
        "application_status": "'applied'",
        "job_posting_url": "''",
    }

    def of(fields: Sequence[str]) -> str:
        return "to_json({" + ", ".join(f"{f}: {values[f]}" for f in fields) + "})"

    return (
        f"CASE WHEN category = 'rejection' THEN CAST({of(schemas.REJECTION_FIELDS)} AS VARCHAR) "
        f"ELSE CAST({of(schemas.APPLICATION_FIELDS)} AS VARCHAR) END"
    )


RECORDS = f"""records AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 10 WHEN 7 THEN 'not json' WHEN 8 THEN ''
    WHEN 9 THEN NULL ELSE {_json('CAST(doc_id AS VARCHAR)')} END AS payload
  FROM routed)"""
REASON = (
    "CASE doc_id % 10 WHEN 7 THEN 'malformed json' WHEN 8 THEN 'empty payload' "
    "WHEN 9 THEN 'null payload' END"
)
PAYLOAD_FIELDS = f"""topic, id AS event_id, source, subject AS raw_subject, body AS raw_body_text,
  sender AS sender_email, received_at, {_text(INGESTED_AT)} AS ingested_at,
  '{rules.SCHEMA_VERSION}' AS schema_version,
  CASE WHEN category = 'rejection' THEN 'unknown' END AS rejection_type,
  CASE WHEN category = 'application' THEN 'applied' END AS application_status,
  CASE WHEN category = 'application' THEN ingest_board END AS job_board"""


def _dead_letters(producer: str, stamp: str, with_offset: bool) -> str:
    place = ", '0', CAST(doc_id AS VARCHAR)" if with_offset else ""
    return f"""WITH {MAILS}, {GATE}, {ROUTED}, {RECORDS}
SELECT sha256(concat_ws(chr(31), topic, {REASON}, coalesce(payload, ''){place})) AS dlq_event_id,
  topic AS original_topic, {REASON} AS failure_reason, coalesce(payload, '') AS raw_payload,
  '{stamp}' AS failed_at, '{producer}' AS producer_name,
  '{rules.SCHEMA_VERSION}' AS schema_version{", replace(topic, 'raw.', 'dlq.') AS topic" if with_offset else ""}
FROM records WHERE {REASON} IS NOT NULL"""


def _plain_words(text: str) -> str:
    return f"trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _candidates(names: str, texts: str, uid: str = "doc_id") -> str:
    """CTE ``candidates``: names of ``names`` in the plain words of ``texts(uid, plain)``."""
    return f"""names AS (
  SELECT DISTINCT name, {_plain_words('name')} AS words FROM ({names}) WHERE {_plain_words('name')} <> ''),
plain_texts AS ({texts}),
candidates AS (
  SELECT p.{uid}, coalesce(string_agg(n.name, '|' ORDER BY
      instr(' ' || p.plain || ' ', ' ' || n.words || ' '), -length(n.words), n.name), '') AS candidates
  FROM plain_texts p LEFT JOIN names n ON contains(' ' || p.plain || ' ', ' ' || n.words || ' ')
  GROUP BY p.{uid})"""


MAIL_CANDIDATES = _candidates(
    f"SELECT {_company('sender')} AS name FROM mails UNION SELECT unnest(['Northwind', 'Contoso'])",
    f"SELECT doc_id, {_plain_words(MAIL_TEXT)} AS plain FROM mails",
)
FIRST_CANDIDATE = f"""first_names AS (
  SELECT m.*, coalesce([c FOR c IN string_split(candidates, '|') IF length(c) > 2
    AND NOT list_contains({_list(rules.ENTITY_NOISE)}, lower(c))][1], '') AS named
  FROM mails m JOIN candidates USING (doc_id))"""
NAMED_COMPANY = f"CASE WHEN named <> '' THEN named ELSE {_company('sender')} END"


def _summary(kind: str) -> str:
    date = "left(replace(received_at, 'T', ' '), 16) || ' UTC'"
    if kind == "rejection":
        return f"""SELECT {date} AS date_received, company_name AS company, role_title AS role,
  rejection_type, source, job_board, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%'
  AS confidence, left(subject, {rules.DISPLAY_SUBJECT_CHARS}) AS subject, event_id
FROM enriched WHERE category = 'rejection'"""
    return f"""SELECT {date} AS date_applied, company_name AS company, role_title AS role,
  'applied' AS status, source, job_board, left(subject, {rules.DISPLAY_SUBJECT_CHARS}) AS subject,
  event_id
FROM enriched WHERE category = 'application'"""


F32 = "CAST(CAST(confidence AS FLOAT) AS DOUBLE)"
METRICS = f"""metrics AS (
  SELECT CAST(0 AS BIGINT) AS batch_id, 'rules' AS backend, category AS event_type,
    count(*) AS batch_size, round(avg({F32}), 6) AS avg_confidence,
    round(min({F32}), 6) AS min_confidence, round(max({F32}), 6) AS max_confidence,
    round(avg(CASE WHEN company_name <> '' THEN 1.0 ELSE 0.0 END), 6) AS company_extraction_rate,
    round(avg(CASE WHEN role_title <> '' THEN 1.0 ELSE 0.0 END), 6) AS role_extraction_rate
  FROM enriched GROUP BY category)"""
DISTRIBUTION = """distribution AS (
  SELECT CAST(0 AS BIGINT) AS batch_id, 'rules' AS backend, category AS event_type,
    rejection_type AS label, count(*) AS label_count,
    round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS label_pct
  FROM enriched GROUP BY category, rejection_type)"""
FIGURES = [
    "batch_size", "avg_confidence", "min_confidence", "max_confidence",
    "company_extraction_rate", "role_extraction_rate",
]


def _hits(patterns: Sequence[str]) -> str:
    text = "regexp_replace(trim(text, E' \\n\\t\\r\\f\\v'), '\\s+', ' ', 'g')"
    return " + ".join(f"CAST({_matches(text, [p])} AS INTEGER)" for p in patterns)


def _scored(rows: str) -> str:
    """CTE ``scored`` with label by pattern shares, over rows with ``text``."""
    threshold = rules.LABEL_THRESHOLD
    return f"""hits AS (
  SELECT *, CAST({_hits(rules.HARD_REJECTION_PATTERNS)} AS DOUBLE) AS h,
    CAST({_hits(rules.SOFT_REJECTION_PATTERNS)} AS DOUBLE) AS f FROM {rows}),
scored AS (
  SELECT *, greatest(h, f, 1) / (h + f + 1) AS scored_score, CASE WHEN greatest(h, f, 1) / (h + f + 1) < {threshold} THEN 'unknown'
    WHEN h >= f AND h >= 1 THEN 'hard_rejection'
    WHEN f >= 1 THEN 'soft_rejection' ELSE 'unknown' END AS scored_label
  FROM hits)"""


HIDDEN = "|".join(f"{tag}\\b[^>]*>.*?</{tag}\\s*>" for tag in ("script", "style"))
MARKUP = f"<(?:!--.*?-->|{HIDDEN}|/?[a-z][^>]*>|[!?][^>]*>)"


# The named references the pages have, apart from the ampersand.
REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "middot": "·",
    "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…", "euro": "€",
}


def _references(text: str) -> str:
    for name, char in REFERENCES.items():
        text = f"regexp_replace({text}, '&{name};?', {_text(char)}, 'g')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def _html(column: str) -> str:
    gap = "chr(1)"
    text = f"regexp_replace({column}, '(?is){MARKUP}', {gap}, 'g')"
    text = f"trim(regexp_replace({text}, '\\x01+', {gap}, 'g'), {gap})"
    return _references(f"replace({text}, {gap}, ' ')")


def _html_nodes(column: str) -> str:
    """Every text node, those of scripts and styles too, joined by one space."""
    pieces = f"regexp_extract_all({column}, '(?is){MARKUP}|[^<]+|<')"
    inside = "regexp_replace(x, '(?is)^<(script|style)\\b[^>]*>|</(script|style)\\s*>$', '', 'g')"
    nodes = (
        f"[CASE WHEN regexp_matches(x, '(?is)^<(script|style)\\b') THEN {inside} "
        f"WHEN regexp_matches(x, '(?is)^{MARKUP}$') THEN '' ELSE {_references('x')} END "
        f"FOR x IN {pieces}]"
    )
    return f"array_to_string([n FOR n IN {nodes} IF n <> ''], ' ')"


def _select(columns: str, *ctes: str, rows: str = "mails") -> str:
    return f"WITH {', '.join((MAILS, *ctes))} SELECT {columns} FROM {rows}"


def _late(columns: str, *ctes: str, rows: str = "mails") -> str:
    return f"WITH {', '.join((LATE_MAILS, *ctes))} SELECT {columns} FROM {rows}"


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    evidence = "has_context, strong_rejection, strong_application, rejection_score, application_score"
    out["classify_gate"] = _select("doc_id, category", GATE, rows="classified")
    out["classify_scores"] = _select(f"doc_id, {evidence}, category", GATE, rows="classified")
    out["classify_whole_text"] = _late("doc_id, category", GATE, rows="classified")
    out["classify_gate_window"] = _late("doc_id, category", WINDOW_GATE, rows="classified")
    out["category_counts"] = (
        _select("category, count(*) AS mails", GATE, rows="classified") + " GROUP BY category"
    )

    out["role_title"] = _select(f"doc_id, {_role(MAIL_TEXT)} AS role_title")
    out["role_title_whole_text"] = _select(f"doc_id, {_role(MAIL_TEXT)} AS role_title")
    out["rejection_type"] = _select(f"doc_id, {_rejection(MAIL_TEXT)} AS rejection_type")
    out["rejection_type_whole_text"] = _select(
        f"doc_id, {_rejection(MAIL_TEXT)} AS rejection_type"
    )
    out["company_from_sender"] = _select(f"doc_id, {_company('sender')} AS company_name")
    out["job_board"] = _select(f"doc_id, {_board('sender')} AS job_board")
    out["job_board_join"] = out["job_board"]
    out["job_board_join_large"] = out["job_board"]
    out["job_board_producer"] = _select(
        f"doc_id, {_board('sender', rules.INGEST_JOB_BOARDS)} AS job_board"
    )
    out["company_candidates"] = _select("doc_id, candidates", MAIL_CANDIDATES, rows="candidates")
    words = f"string_split({_plain_words('text')}, ' ')"
    out["company_candidates_join"] = "WITH " + _candidates(
        f"SELECT w AS name FROM (SELECT unnest({words}) AS w FROM benchmark) "
        "WHERE regexp_matches(w, '^\\p{Lu}\\p{L}{4,}$')",
        f"SELECT doc_id, {_plain_words('text')} AS plain FROM documents",
    ) + " SELECT doc_id, candidates FROM candidates"
    out["company_candidates_join_large"] = out["company_candidates_join"]
    out["entity_noise_filter"] = _select(
        f"doc_id, {NAMED_COMPANY} AS company_name", MAIL_CANDIDATES, FIRST_CANDIDATE,
        rows="first_names",
    )

    columns = "doc_id, company_name, role_title, rejection_type, job_board, confidence"
    out["enrich_rejections"] = _select(
        columns, _enriched_from("mails", MAIL_TEXT, _rejection(MAIL_TEXT)), rows="enriched"
    )
    out["enrich_applications"] = _select(
        columns, _enriched_from("mails", MAIL_TEXT, "'n/a'"), rows="enriched"
    )
    out["enrich_whole_text"] = _late(
        columns, _enriched_from("mails", MAIL_TEXT, _rejection(MAIL_TEXT)), rows="enriched"
    )
    out["enrich_rejections_window"] = _late(
        columns, _enriched_from("mails", WINDOW_MAIL_TEXT, _rejection(WINDOW_MAIL_TEXT)), rows="enriched"
    )
    out["enrich_with_candidates"] = _select(
        columns,
        MAIL_CANDIDATES,
        FIRST_CANDIDATE,
        _enriched_from("first_names", MAIL_TEXT, _rejection(MAIL_TEXT), NAMED_COMPANY),
        rows="enriched",
    )

    out["events_envelope"] = _select(
        f"topic, source AS key, {_json('event_id')} AS value, "
        f"'schema_version={rules.SCHEMA_VERSION};source=' || source AS headers",
        GATE, ROUTED, rows="routed",
    )
    out["route_topics"] = (
        _select("topic, source, count(*) AS mails", GATE, ROUTED, rows="routed")
        + " GROUP BY topic, source"
    )
    out["json_parse_flatten"] = (
        _select(PAYLOAD_FIELDS, GATE, ROUTED, RECORDS, rows="records") + f" WHERE {REASON} IS NULL"
    )
    out["dlq_split"] = _dead_letters("replay-test", "2024-06-01T00:00:00+00:00", True)
    out["dlq_audit"] = (
        _select(
            f"topic AS original_topic, {REASON} AS failure_reason, count(*) AS letters",
            GATE, ROUTED, RECORDS, rows="records",
        )
        + f" WHERE {REASON} IS NOT NULL GROUP BY ALL"
    )
    size = "octet_length(encode(payload))"
    out["dlq_replay"] = (
        _select(
            "topic, id AS event_id, source, subject AS raw_subject, body AS raw_body_text",
            GATE, ROUTED, RECORDS, rows="records",
        )
        + f" WHERE {size} > {OVERSIZE_BYTES}"
    )
    out["oversize_split"] = _select(
        f"doc_id AS \"offset\", CASE WHEN {size} > {OVERSIZE_BYTES} THEN 'oversize' "
        f"ELSE coalesce({REASON}, 'good') END AS state",
        GATE, ROUTED, RECORDS, rows="records",
    )

    away = _json("event_id")
    out["publish_dlq"] = (
        _select(
            f"sha256(concat_ws(chr(31), topic, 'oversize', {away})) AS dlq_event_id, topic AS original_topic, "
            f"'oversize' AS failure_reason, {away} AS raw_payload, {_text(INGESTED_AT)} AS failed_at, "
            f"'ingest' AS producer_name, '{rules.SCHEMA_VERSION}' AS schema_version, "
            "replace(topic, 'raw.', 'dlq.') AS topic",
            GATE, ROUTED, rows="routed",
        )
        + f" WHERE octet_length(encode({away})) > {OVERSIZE_BYTES}"
    )
    cutoff = f"TIMESTAMP '{MAILBOX_ASOF}' - INTERVAL 10 DAY"
    out["mailbox_recent"] = (
        _select("doc_id AS uid, source, subject, received_at")
        + f" WHERE NOT is_read AND received_at >= strftime({cutoff}, '%Y-%m-%dT%H:%M:%S')"
        + f" ORDER BY uid DESC LIMIT {MAILBOX_ROWS}"
    )
    out["mailbox_oldest"] = (
        _select("doc_id AS uid, subject, sender, received_at, body")
        + " WHERE NOT is_read ORDER BY received_at, uid LIMIT 50"
    )
    out["mailbox_recent_by_source"] = (
        _select("doc_id AS uid, source, received_at")
        + " WHERE NOT is_read QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 100"
    )
    out["unseen_only"] = (
        _select("doc_id AS uid, source, subject")
        + " WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = mails.doc_id)"
    )
    specs = ", ".join(str(tuple(spec)) for spec in rules.TOPIC_SPECS)
    out["missing_specs"] = (
        _select(
            "*", GATE, ROUTED,
            f"specs(name, partitions, replication, retention_days) AS (VALUES {specs})",
            rows="specs",
        )
        + " WHERE NOT EXISTS (SELECT 1 FROM routed WHERE topic = name)"
    )
    topics = _list([spec[0] for spec in rules.TOPIC_SPECS])
    out["retention"] = f"""WITH stamped AS (
  SELECT event_id, {topics}[event_id % {len(rules.TOPIC_SPECS)} + 1] AS topic,
    strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT * FROM stamped WHERE day >= strftime(DATE '{ASOF}' - INTERVAL 1 DAY *
  (CASE WHEN topic LIKE 'raw.%' THEN 7 ELSE 30 END), '%Y-%m-%d')"""
    delivery_id = EVENT_ID
    out["dedup_events"] = (
        _select(f"doc_id, {delivery_id} AS event_id, received_at, CAST(0 AS INTEGER) AS attempt")
        + f" QUALIFY row_number() OVER (PARTITION BY {delivery_id} ORDER BY received_at, doc_id) = 1"
    )
    out["source_order"] = _select(
        "event_id, source, received_at, "
        "row_number() OVER (PARTITION BY source ORDER BY received_at, event_id) AS position",
        GATE, ROUTED, rows="routed",
    )

    out["sheet_rejections"] = f"WITH {ENRICHED} {_summary('rejection')}"
    out["sheet_applications"] = f"WITH {ENRICHED} {_summary('application')}"
    out["latest_rows"] = out["sheet_rejections"] + f" ORDER BY date_received DESC, event_id LIMIT {LATEST_ROWS}"

    out["batch_metrics"] = (
        f"WITH {ENRICHED}, {METRICS} SELECT *, CAST(2.5 AS DOUBLE) AS batch_latency_seconds, "
        "round(batch_size / CAST(2.5 AS DOUBLE), 6) AS throughput_events_per_sec FROM metrics"
    )
    out["label_distribution"] = f"WITH {ENRICHED}, {DISTRIBUTION} SELECT * FROM distribution"
    keys = "batch_id, backend, event_type"
    long = " UNION ALL ".join(
        [
            *[f"SELECT {keys}, '{f}' AS key, CAST({f} AS DOUBLE) AS value FROM metrics" for f in FIGURES],
            f"SELECT {keys}, 'label_count_' || label, CAST(label_count AS DOUBLE) FROM distribution",
            f"SELECT {keys}, 'label_pct_' || label, label_pct FROM distribution",
        ]
    )
    out["metric_rows"] = f"WITH {ENRICHED}, {METRICS}, {DISTRIBUTION} {long}"
    out["backend_comparison"] = _select(
        f"'rules' AS backend, round(avg({F32}), 6) AS avg_confidence, count(*) AS sample_size",
        _enriched_from("mails", MAIL_TEXT, _rejection(MAIL_TEXT)),
        f"texts AS (SELECT {MAIL_TEXT} AS text FROM mails)", _scored("texts"),
        rows="enriched",
    ) + " UNION ALL SELECT 'scored', round(avg(scored_score), 6), count(*) FROM scored"
    out["output_summary"] = f"""WITH {ENRICHED}
SELECT kind AS event_type, (SELECT count(*) FROM enriched WHERE category = kind) AS rows
FROM (VALUES ('rejection'), ('application')) k(kind)"""
    out["throughput"] = """WITH spans AS (
  SELECT event_type, count(*) AS events,
    CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS DOUBLE) AS seconds
  FROM events GROUP BY event_type)
SELECT *, round(events / greatest(seconds, 0.001), 6) AS events_per_sec FROM spans"""

    out["label_argmax"] = """SELECT vec_id, CASE WHEN list_max(embedding) >= CAST(0.25 AS DOUBLE)
  THEN 'dim_' || list_position(embedding, list_max(embedding)) ELSE 'unknown' END AS top_label
FROM embeddings"""
    out["scored_labels"] = _select(
        "doc_id, scored_label AS label",
        f"texts AS (SELECT doc_id, {MAIL_TEXT} AS text FROM mails)", _scored("texts"),
        rows="scored",
    )
    out["label_encode"] = _select(
        "doc_id, label, CAST(list_position("
        + _list(rules.REJECTION_LABELS)
        + ", label) - 1 AS BIGINT) AS label_id, label AS decoded",
        f"labelled AS (SELECT doc_id, {_rejection(MAIL_TEXT)} AS label FROM mails)", rows="labelled",
    )
    words = "regexp_replace(trim(text, E' \\n\\t\\r\\f\\v'), '\\s+', ' ', 'g')"
    token = f"unnest(list_filter(string_split({_plain_words('lower(text)')}, ' '), lambda w: w <> ''))"
    places = _list(rules.REJECTION_LABELS)
    out["text_classifier"] = _select(
        f"""doc_id, CASE WHEN score < {rules.LABEL_THRESHOLD} THEN 'unknown' ELSE label END AS label,
  round(score, 4) AS score""",
        f"labelled AS (SELECT doc_id, {MAIL_TEXT} AS text, {_rejection(MAIL_TEXT)} AS label FROM mails)",
        f"words AS (SELECT doc_id, label, {token} AS token FROM labelled)",
        "counts AS (SELECT label, token, count(*) AS n FROM words GROUP BY ALL)",
        "size AS (SELECT count(DISTINCT token) AS v FROM counts)",
        """classes AS (
  SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM labelled)) AS prior,
    coalesce((SELECT sum(n) FROM counts c WHERE c.label = l.label), 0) AS total
  FROM labelled l GROUP BY label)""",
        "own AS (SELECT doc_id, token, count(*) AS n FROM words GROUP BY ALL)",
        """sums AS (
  SELECT o.doc_id, k.label, sum(o.n * ln((coalesce(c.n, 0) + 1)::DOUBLE / (k.total + v))) AS s
  FROM own o CROSS JOIN classes k CROSS JOIN size LEFT JOIN counts c ON c.label = k.label AND c.token = o.token
  GROUP BY ALL)""",
        """logs AS (
  SELECT l.doc_id, k.label, k.prior + coalesce(s.s, 0) AS x
  FROM labelled l CROSS JOIN classes k LEFT JOIN sums s ON s.doc_id = l.doc_id AND s.label = k.label)""",
        f"""ranked AS (
  SELECT doc_id, label, 1 / sum(exp(x - m)) OVER (PARTITION BY doc_id) AS score,
    row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, list_position({places}, label)) AS rank
  FROM (SELECT *, max(x) OVER (PARTITION BY doc_id) AS m FROM logs))""",
        rows="ranked",
    ) + " WHERE rank = 1"
    out["first_words"] = (
        f"SELECT doc_id, array_to_string(string_split({words}, ' ')[1:{LABEL_WORDS}], ' ') AS words "
        "FROM documents"
    )

    local = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    out["mail_dates"] = f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN {local} || '+02:00'
  WHEN 1 THEN {local} || '-07:30' WHEN 2 THEN {local} || '+00:00' WHEN 3 THEN {local} || '-05:00'
  WHEN 4 THEN {local} WHEN 5 THEN {local}
  ELSE 'not a date ' || event_id END AS received_at FROM events"""
    shift = "CASE event_id % 4 WHEN 0 THEN INTERVAL 120 MINUTE WHEN 2 THEN INTERVAL '-450 minutes' ELSE INTERVAL 0 MINUTE END"
    out["display_dates"] = f"""SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 'not a date'
  ELSE strftime(ts - {shift}, '%Y-%m-%d %H:%M') || ' UTC' END AS shown FROM events"""
    out["html_text"] = f"SELECT page_id, {_html('html')} AS text FROM pages"
    out["html_text_parsed"] = f"SELECT page_id, {_html_nodes('html')} AS text FROM pages"
    out["mail_normalise"] = f"""SELECT CAST(page_id AS VARCHAR) AS uid, 'outlook' AS source,
  CASE WHEN page_id % 4 <> 0 THEN 'Page ' || page_id ELSE '' END AS subject,
  CASE WHEN page_id % 5 <> 0 THEN url ELSE '' END AS sender,
  '2024-01-01T00:00:00Z' AS received_at,
  CASE WHEN page_id % 3 = 0 THEN html ELSE {_html('html')} END AS body FROM pages"""
    out["mime_decode"] = _select(
        "doc_id AS uid, subject, sender, received_at, "
        "regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS body, CAST(NULL AS VARCHAR) AS error"
    )

    good = f"{REASON} IS NULL"
    out["stream_pipeline"] = f"""WITH {ENRICHED}
SELECT {PAYLOAD_FIELDS.replace('topic, id AS event_id', 'CAST(doc_id AS VARCHAR) AS event_id')
        .replace("CASE WHEN category = 'rejection' THEN 'unknown' END AS rejection_type",
                 "CASE WHEN category = 'rejection' THEN rejection_type END AS rejection_type")
        .replace("CASE WHEN category = 'application' THEN ingest_board END AS job_board", "job_board")},
  company_name, role_title, confidence AS nlp_confidence, '{STREAM_STAMP}' AS processed_at,
  category AS event_type
FROM enriched WHERE {good}"""
    out["stream_backfill"] = out["stream_pipeline"]
    out["stream_backfill_overlap"] = out["stream_pipeline"]
    out["stream_ordered"] = out["source_order"]
    out["stream_summary"] = f"""WITH {ENRICHED}
SELECT category AS event_type, count(*) FILTER ({good}) AS rows, count(*) FILTER (NOT ({good})) AS dead_letters
FROM enriched GROUP BY category"""
    out["stream_short_ranges"] = f"""WITH {MAILS}, {GATE}, {ROUTED}, {RECORDS}
SELECT topic, CAST(0 AS INTEGER) AS partition, min(doc_id) AS first, max(doc_id) AS last, count(*) AS records,
  max(doc_id) - min(doc_id) + 1 - count(*) AS missing
FROM records GROUP BY topic HAVING max(doc_id) - min(doc_id) + 1 > count(*)"""
    out["offset_gaps"] = """WITH places AS (
  SELECT 'events' AS topic, CAST(event_id % 4 AS INTEGER) AS partition, event_id // 4 AS place FROM events
), ends AS (SELECT topic, partition, min(place) - 3 AS first, max(place) + 2 AS last FROM places GROUP BY ALL
), marks AS (
  SELECT * FROM places WHERE NOT (place % 250 BETWEEN 40 AND 44 OR (partition = 2 AND place BETWEEN 300 AND 420))
  UNION ALL SELECT topic, partition, first - 1 FROM ends UNION ALL SELECT topic, partition, last + 1 FROM ends
), steps AS (SELECT *, lag(place) OVER (PARTITION BY topic, partition ORDER BY place) AS before FROM marks)
SELECT topic, partition, before + 1 AS first_missing, place - 1 AS last_missing, place - before - 1 AS missing
FROM steps WHERE place - before > 1"""
    sheets = [
        _summary(kind).replace("event_id\nFROM", "CAST(doc_id AS VARCHAR) AS event_id\nFROM") + f" AND {good}"
        for kind in ("rejection", "application")
    ]
    out["stream_sinks"] = f"""WITH {ENRICHED}
SELECT *, 'rejection' AS tab FROM ({sheets[0]}) UNION ALL BY NAME
SELECT *, 'application' AS tab FROM ({sheets[1]})"""
    out["stream_dlq"] = _dead_letters("stream", STREAM_STAMP, True).replace(
        ", replace(topic, 'raw.', 'dlq.') AS topic", ""
    )
    out["stream_metrics"] = f"""WITH {ENRICHED}
SELECT category AS event_type, 'rules' AS backend, CAST(count(*) AS DOUBLE) AS events
FROM enriched WHERE {good} GROUP BY category"""
    out["stream_dedup"] = (
        _select(f"{delivery_id} AS event_id") + " WHERE doc_id % 50 <> 0 GROUP BY 1 UNION ALL "
        "SELECT NULL FROM (SELECT unnest(range(doc_id % 3 + 1)) FROM mails WHERE doc_id % 50 = 0)"
    )
    return out
