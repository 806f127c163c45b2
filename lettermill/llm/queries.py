"""The operators as named queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import (
    decontaminate,
    fingerprints,
    licenses,
    merkle,
    neighbours,
    packing,
    phrases,
    quality,
    secrets,
    simhash,
    tokens,
    toxicity,
    urls,
)
from lettermill.llm.common import table

GRADES = 3
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Hosts whose pages are put on the list of blocked urls.
LISTED_HOSTS = r"(?:^|\.)(?:spam-farm|cheap-pills|casino-win|ads-track)\."


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from 0: junk, readable but toxic, good."""
    grade = F.when(F.col("quality") == 0, 0).otherwise(F.when(F.col("toxic") == 1, 1).otherwise(2))
    rated = labels.filter("quality is not null and toxic is not null")
    return rated.select("doc_id", grade.cast("int").alias("label"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = fingerprints.edit_probe(table(spark, sf_dir, "documents"))
    own, changed, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return probe.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.concat_ws(",", own).alias("fingerprint"),
        F.concat_ws(",", changed).alias("edited_fingerprint"),
        F.round(fingerprints.resemblance(own, changed), 6).alias("near_edited"),
        F.round(fingerprints.resemblance(own, following), 6).alias("near_next"),
        F.round(fingerprints.containment(own, changed), 6).alias("kept_in_edited"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.toxicity(docs, model)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def listed_pages(pages: DataFrame) -> DataFrame:
    """``key``: canonical urls of the pages on listed hosts."""
    bad = urls.host(pages["url"]).rlike(LISTED_HOSTS)
    return pages.filter(bad).select(urls.canonical(pages["url"]).alias("key"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, listed_pages(pages), URL_RULES)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.OrdinalModel:
    return quality.fit_quality(docs, grades(table(spark, sf_dir, "labels")), GRADES)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality_model(spark, docs, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def secret_forest(spark: SparkSession, docs: DataFrame):
    words = secrets.dictionary(spark, tokenizer_file("word_bpe_49k.json"))
    return words, secrets.fit_forest(secrets.labelled_findings(docs, "source"), words)


def masked(value: Column) -> Column:
    shown = F.least(F.lit(4), F.floor(F.length(value) / 3).cast("int"))
    return F.concat(F.substring(value, F.lit(1), shown), F.lit("..."), F.substring(F.sha2(value, 256), 1, 16))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words, forest = secret_forest(spark, docs)
    found = secrets.scan_secrets(docs, words, forest, "source")
    return found.select(
        "doc_id", "word_at", masked(F.col("value")).alias("value"), F.length("value").alias("length"), "score", "is_secret"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.verify(merkle.manifest(docs, other_leaf=merkle.tampered_leaf(docs)))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_license_scan,
        op3_token_counts,
        op4_benchmark_decontamination,
        op5_toxicity,
        op6_best_fit_packing,
        op7_url_filter,
        op8_quality_classifier,
        op9_simhash_near_dedup,
        op10_secret_scan,
        op11_merkle_manifest,
        op12_collocations,
        op13_nearest_neighbours,
        pipeline,
    )
}

_SPACES = r"[\x09-\x0D\x20]+"
_HASHES = """
list_transform(
    range(1, len({words}) - least({n}, len({words})) + 2),
    lambda i: md5(array_to_string(list_slice({words}, i, i + least({n}, len({words})) - 1), ' '))[1:{digits}]
)"""
_SKETCH = """
CASE WHEN len({all}) = 0 THEN []::VARCHAR[]
     WHEN len(list_filter({all}, lambda h: h < '{bound}')) > 0
     THEN list_sort(list_distinct(list_filter({all}, lambda h: h < '{bound}')))
     ELSE [list_min({all})] END"""


def _sketch_sql(hashes: str) -> str:
    return _SKETCH.format(all=hashes, bound=fingerprints.threshold())


def _hashes_sql(words: str) -> str:
    return _HASHES.format(words=words, n=fingerprints.WORDS, digits=fingerprints.DIGITS)


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACES}'), lambda w: w <> '')"


def _alike_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE"
        f" / len(list_distinct(list_concat({a}, {b}))) END"
    )


def _manifest_sql() -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"

    def leaf(n_chars: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
        return f"sha256({' || '.join(map(field, values))})"

    # CRC-32 of the id's decimal digits, bit by bit.
    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    crc = (
        "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda crc, d: "
        f"list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c ELSE {step.format(c='c')} END, xor(crc, d)),"
        " 4294967295::BIGINT), 4294967295)"
    )
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
    CASE WHEN coalesce({crc} % 7 = 0, FALSE) THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM rows
), tree(lang, level, pos, n, node) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, pos, n, node) AS (
  SELECT 0, pos, n, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), climb(lang, doc_id, leaf, other, start, level, pos, n, node, proof) AS (
  SELECT lang, doc_id, leaf, other, pos, 0, pos, n, other, '' FROM leaves
  UNION ALL
  SELECT c.lang, c.doc_id, c.leaf, c.other, c.start, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(t.node, '') || c.node ELSE c.node || coalesce(t.node, '') END),
    c.proof || coalesce(t.node, '')
  FROM climb c LEFT JOIN tree t
    ON t.lang IS NOT DISTINCT FROM c.lang AND t.level = c.level AND t.pos = xor(c.pos, 1)
  WHERE c.n > 1
), over(lang, doc_id, leaf, start, level, pos, n, node, proof, subroot) AS (
  SELECT c.lang, c.doc_id, c.leaf, c.start, 0, s.pos, s.n, c.node, c.proof, s.node
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.lang, c.doc_id, c.leaf, c.start, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(t.node, '') || c.node ELSE c.node || coalesce(t.node, '') END),
    c.proof || coalesce(t.node, ''), c.subroot
  FROM over c LEFT JOIN top t ON t.level = c.level AND t.pos = xor(c.pos, 1) WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, over.node AS folded_root,
  over.node = root.node AS verified
FROM over, (SELECT node FROM top WHERE n = 1) AS root WHERE over.n = 1"""


def _collocations_sql() -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(string_split_regex(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang
), spans AS (SELECT lang, w, m.m AS m, unnest(range(1, len(w) - m.m + 2)) AS i FROM runs, range(1, 5) AS m(m) WHERE len(w) >= m.m
), f AS (
  SELECT lang, m, w[i:i + m - 1] AS gram, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= {phrases.LEAST}
), held AS (
  SELECT lang, gram[i:i + k - 1] AS gram, max(f) AS longer
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2)) GROUP BY ALL
), kept AS (
  SELECT f.lang, f.m, f.gram, f.f AS a FROM f LEFT JOIN held USING (lang, gram)
  WHERE m > 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * f.f, FALSE)
), cuts AS (
  SELECT kept.lang, kept.gram, a, k, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f + q.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) AS kept
  JOIN f AS p ON p.lang = kept.lang AND p.gram = kept.gram[1:k]
  JOIN f AS q ON q.lang = kept.lang AND q.gram = kept.gram[k + 1:]
), best AS (
  SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.TOP}"""


def oracles() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    op1 = f"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL
), follows AS (
  SELECT doc_id, text,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC, text), first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next
  FROM rows
), edits AS (
  SELECT *, left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) AS edited FROM follows
), words AS (
  SELECT *, {_words_sql("text")} AS w, {_words_sql("edited")} AS we, {_words_sql("next")} AS wn FROM edits
), hashes AS (
  SELECT doc_id, text, edited, {_hashes_sql("w")} AS h, {_hashes_sql("we")} AS he, {_hashes_sql("wn")} AS hn FROM words
), sketches AS (
  SELECT doc_id, text, edited, {_sketch_sql("h")} AS s, {_sketch_sql("he")} AS se, {_sketch_sql("hn")} AS sn FROM hashes
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  coalesce(array_to_string(s, ','), '') AS fingerprint, coalesce(array_to_string(se, ','), '') AS edited_fingerprint,
  round({_alike_sql("s", "se")}, 6) AS near_edited,
  round({_alike_sql("s", "sn")}, 6) AS near_next,
  round(CASE WHEN len(s) = 0 THEN 1.0 ELSE len(list_intersect(s, se))::DOUBLE / len(s) END, 6) AS kept_in_edited
FROM sketches"""
    fits = [
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"
        f" THEN {{{{'rule': '{name}{start}', 'verdict': '{verdict}'}}}}"
        for name, start, verdict in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    op7 = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.UPPER.lower()}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), named AS (
  SELECT *, nullif(regexp_replace(host, '^(?:www|m)\\.', ''), '') || regexp_replace(path, '(?:\\.html|/+)$', '') AS canonical,
    CASE {" ".join(fits)} END AS found
  FROM parts
), list AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED_HOSTS}'))
SELECT page_id, host, path, found.rule AS rule,
  coalesce(found.verdict, CASE WHEN list.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  list.canonical IS NOT NULL AS listed
FROM named LEFT JOIN list ON named.canonical = list.canonical""".replace("{{", "{").replace("}}", "}")
    return {"op1_document_fingerprints": op1, "op7_url_filter": op7, "op11_merkle_manifest": _manifest_sql(), "op12_collocations": _collocations_sql()}
