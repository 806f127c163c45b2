"""Secret scans: candidate strings, judged by a random forest. Columns and Spark ML only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.text import let
from lettermill.llm.common import fresh, store, whole_text
from lettermill.llm.samples import least_hashed

SHORTEST = 12
SHORTEST_GIVEN = 6
SAMPLE = 6000
SECRET_AT = 0.5
MASK = "[SECRET]"
SPACES = r"[\x09-\x0D\x20]+"
_RUN = r"[A-Za-z0-9+/_.\-]"
_VALUE = rf"^{_RUN}{{{SHORTEST - 1},}}[A-Za-z0-9+/_]={{0,2}}$"
_LONG = rf"{_RUN}{{{SHORTEST - 1}}}"
# What an assigning sign gives: a quoted value; else all up to a delimiter (an "&" before a further
# key is one), behind ":" also up to a further sign.
_END = r"""(?:={1,2}(?![^"'`,;&(){}\[\]<>]))?"""
_GIVEN = r"""(?<=[=:]")[^"]+(?=")|(?<=[=:]')[^']+(?=')""" + "".join(
    rf"""|(?<={sign}["'`]?)[^"'`=:/,;&(){{}}\[\]<>]{more}*(?:&(?!\w*=){more}*){{0,64}}{_END}"""
    for sign, more in (("=", r"""[^"'`=,;&(){}\[\]<>]"""), (":", r"""[^"'`=:,;&(){}\[\]<>]"""))
)
# The parts of a word: given values, runs with their padding, and what lies between, up to an assigning sign.
_PARTS = (
    rf"""{_GIVEN}|{_RUN}+{_END}|"""
    rf"""[^A-Za-z0-9+/_.\-]+?(?=$|{_RUN}|(?<=[=:]["'`]?).)"""
)
_SIGN = r"""[=:]["'`]?$"""
_NAMES = r"token|secret|passw|pwd|api.?key|auth|credential|private|access|signature|bearer"
_HARMLESS = (
    r"commit|revision|checksum|digest|sha\d*|md5|hash|uuid|guid|build|version|example|sample|dummy|test|"
    r"phone|card|order|invoice|isbn|account|mail|http|ticket"
)
_PATHS = r"test|example|sample|fixture|mock|doc|demo"
FEATURES = [
    "length", "digits", "capitals", "small", "signs", "changes", "different", "longest_run", "hexadecimal",
    "only_digits", "covered", "vowels", "dots", "assigned", "secret_name", "harmless_near", "test_path", "mail_or_url",
]


def _near(words: Column, at: Column) -> Column:
    """The word at a place counted from 0, lower-cased; empty outside the text."""
    return F.coalesce(F.lower(F.get(words, at)), F.lit(""))


def _behind(before: Column) -> Column:
    """Whether the word before gives the next one a value."""
    return before.rlike(rf"[=:]$|(?:{_NAMES})\w*\W*$")


def _parts(word: Column, before: Column) -> Column:
    """The parts of a word; joined they are the word, with ``=`` ahead of it if the word before assigns it."""
    return F.regexp_extract_all(F.concat(F.when(_behind(before), "=").otherwise(""), word), F.lit(_PARTS), F.lit(0))


def candidates(docs: DataFrame, path_column: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Strings that could be secrets, one row each: ``doc_id``, ``word_at`` (the word's
    place in the text from 0), ``part_at`` (its place among the word's parts), ``value``,
    ``before2``, ``before``, ``after``, ``word`` (the value and what is next to it in its word), ``path``.

    Candidates are all runs of at least 12 letters, digits and ``+/_.-`` in a
    word, with a digit, or with a sign of assignment before them; and all values
    of at least 6 characters of any kind, quoted or not, behind a sign of assignment
    or a secret name, with a digit or a secret name. A name to which the
    word itself gives a value is none unless it has a digit. ``before`` is the key
    inside the word if there is one. ``path`` is where the text comes from
    (empty if there is no such column).
    """
    where = F.coalesce(docs[path_column].cast("string"), F.lit("")) if path_column else F.lit("")
    split = F.split(whole_text(docs), SPACES)

    def found(words: Column) -> Column:
        def possible(at: Column) -> Column:
            word, before = F.get(words, at), _near(words, at - 1)
            assigned = word.rlike(r"[=:]") | before.rlike(r"[=:]$")
            given = assigned | (before.rlike(rf"(?:{_NAMES})\w*\W*$") & word.rlike(r"\d"))
            return (F.length(word) >= SHORTEST_GIVEN) & (given | (word.rlike(r"\d") & word.rlike(_LONG)))

        def described(at: Column) -> Column:
            return F.struct(
                at.alias("word_at"), F.get(words, at).alias("word"), _near(words, at - 2).alias("before2"),
                _near(words, at - 1).alias("before"), _near(words, at + 1).alias("after"),
            )

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), possible), described)

    rows = docs.select(
        docs["doc_id"].alias("doc_id"), where.alias("path"), *[docs[c].alias(c) for c in keep],
        F.explode(let(split, found)).alias("c"),
    )
    word, before, before2 = F.col("c.word"), F.col("c.before"), F.col("c.before2")

    def valued(parts: Column) -> Column:
        def part(at: Column) -> Column:
            return F.coalesce(F.get(parts, at), F.lit(""))

        def one(at: Column) -> Column:
            inside = F.concat(part(at - 3), part(at - 2), part(at - 1))
            return F.struct(
                at.alias("part_at"), F.regexp_replace(part(at), r"[.\-]+$", "").alias("value"), inside.alias("inside"),
                F.concat(inside, part(at), part(at + 1)).alias("near"),
                (part(at + 1).rlike(r"""^["'`]?[=:]""") & ~part(at).rlike(r"\d")).alias("key"),
            )

        places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.length(part(i)) >= SHORTEST_GIVEN)
        return F.transform(places, one)

    rows = rows.select("doc_id", "path", *keep, "c", F.explode(let(_parts(word, before), valued)).alias("v"))
    inside, value = F.lower("v.inside"), F.col("v.value")
    within = inside.rlike(r"[a-z0-9]")
    closest = F.regexp_replace(inside, r"""["'`(\[{<]+$""", "")
    digit = value.rlike(r"\d")
    run = value.rlike(_VALUE) & (digit | before.rlike(r"[=:]$") | word.rlike(r"[=:]"))
    named = F.concat_ws(" ", F.when(within, inside).otherwise(F.concat_ws(" ", before2, before))).rlike(_NAMES)
    given = inside.rlike(_SIGN) & (F.length(value) >= SHORTEST_GIVEN) & (digit | named)
    return rows.filter((run | given) & ~F.col("v.key")).select(
        "doc_id", "path", *keep, "c.word_at", "v.part_at", F.col("v.near").alias("word"), "v.value",
        F.when(within, before).otherwise(before2).alias("before2"),
        F.when(within, closest).otherwise(before).alias("before"), "c.after",
    )


def dictionary(spark: SparkSession, vocabulary: str) -> DataFrame:
    """``entry``: the words of four or more letters in a public tokenizer file, read on the driver.

    At most as many as the vocabulary has entries.
    """
    from tokenizers import Tokenizer

    entries = {w.removesuffix("</w>") for w in Tokenizer.from_file(vocabulary).get_vocab() if w.endswith("</w>")}
    words = sorted(w for w in entries if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower())
    # One value, split by Spark and stored: plans that use the words don't hold them.
    entries = spark.range(0, 1, 1, 1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias("entry"))
    return store(entries.filter("entry <> ''"), "dictionary")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``candidates`` with the columns of FEATURES."""
    value = F.col("value")
    size = F.length(value)
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / size
    kinds = value
    for pattern, sign in ((r"[0-9]", "0"), (r"[a-z]", "a"), (r"[A-Z]", "A"), (r"[^0aA]", "-")):
        kinds = F.regexp_replace(kinds, pattern, sign)
    name = F.concat_ws(" ", "before2", "before", F.lower("word"))
    near = F.concat_ws(" ", "before2", "before", "after", F.lower("word"))
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{4,})"), F.lit(1))).alias("entry"))
    # Bounded by the vocabulary.
    covered = (
        runs.join(F.broadcast(words), "entry").groupBy("value").agg(F.sum(F.length("entry")).alias("letters"))
    )
    flag = lambda c: c.cast("double")
    with_kinds = found.withColumn("kinds", kinds)
    steps = F.regexp_replace(F.col("kinds"), r"(.)\1+", "$1")
    runs_of = F.regexp_extract_all(F.col("kinds"), F.lit(r"(a+|A+|0+|-+)"), F.lit(1))
    return with_kinds.join(covered, "value", "left").select(
        *found.columns,
        size.cast("double").alias("length"),
        share(r"[^0-9]").alias("digits"),
        share(r"[^A-Z]").alias("capitals"),
        share(r"[^a-z]").alias("small"),
        share(r"[A-Za-z0-9]").alias("signs"),
        ((F.length(steps) - 1) / size).alias("changes"),
        (F.size(F.array_distinct(F.split(value, ""))) / size).alias("different"),
        (F.array_max(F.transform(runs_of, F.length)) / size).alias("longest_run"),
        flag(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hexadecimal"),
        flag(value.rlike(r"^[0-9.\-]+$")).alias("only_digits"),
        (F.coalesce("letters", F.lit(0)) / size).alias("covered"),
        (F.length(F.regexp_replace(value, r"(?i)[^aeiou]", "")) / size).alias("vowels"),
        share(r"[^.]").alias("dots"),
        flag(F.col("before").rlike(r"[=:]$") | F.col("word").rlike(r"[=:]")).alias("assigned"),
        flag(name.rlike(_NAMES)).alias("secret_name"),
        flag(near.rlike(_HARMLESS)).alias("harmless_near"),
        flag(F.lower("path").rlike(_PATHS)).alias("test_path"),
        flag(F.col("word").rlike(r"@|://|www\.")).alias("mail_or_url"),
    )


def labelled_findings(docs: DataFrame, path_column: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """Labelled findings set into the words of at most ``sample`` documents: ``doc_id``, ``text``, ``path``, ``label``.

    The documents whose hashes are smallest each carry one finding of a kind
    that their hash picks: keys and tokens of common forms behind names that
    assign them (1), or what scanners report by mistake (0): card and phone
    numbers, mail and web addresses, versions, UUIDs, checksums, commits, identifiers,
    placeholders. Values come from hashes of the text, so they are the same in
    every run.
    """
    where = F.coalesce(docs[path_column].cast("string"), F.lit("")) if path_column else F.lit("")
    text = whole_text(docs)
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), where.alias("path"), F.xxhash64(text, docs["doc_id"]).alias("seed"),
        F.slice(F.split(F.substring(text, 1, 400), SPACES), 1, 24).alias("words"),
    )
    rows = least_hashed(rows, "seed", sample, "doc_id")
    seed = F.col("seed").cast("string")
    hex40, hex32, hex64 = F.sha1(seed), F.md5(seed), F.sha2(seed, 256)
    base64 = F.base64(F.unhex(hex64))
    mixed = F.regexp_replace(base64, r"[+/=]", "x")
    digits = F.regexp_replace(F.conv(F.substring(hex64, 1, 15), 16, 10), r"^", "40")
    short = F.concat(F.substring(mixed, 3, 6), F.substring(hex64, 9, 2), F.substring(mixed, 11, 2))
    number = lambda at, n: F.substring(digits, at, n)
    word = lambda k: F.coalesce(F.get("words", F.lit(k)), F.lit("and"))
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    uuid = F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    octet = lambda bits: F.pmod(F.shiftright("seed", bits), F.lit(256)).cast("string")
    kinds = [
        (1, cat("token = ", quoted(hex40))),
        (1, cat("TOKEN = ", quoted(F.upper(hex40)))),
        (1, cat("api_key: ", hex32)),
        (1, cat("secret = ", quoted(base64))),
        (1, cat("aws_access_key_id = AKIA", F.upper(F.substring(F.regexp_replace(mixed, "[^A-Za-z0-9]", ""), 1, 16)))),
        (1, cat("auth ghp_", F.substring(mixed, 1, 36))),
        (1, cat("password = ", quoted(F.substring(mixed, 3, 14)))),
        (1, cat("client_secret=", F.substring(mixed, 5, 30))),
        (1, cat(word(6), " token ", F.substring(hex64, 1, 40))),
        (1, cat("password=", short)),
        (1, cat("password: ", quoted(cat(short, "!", number(4, 2))))),
        (1, cat('{"user":"', word(3), '","pwd":"', F.substring(mixed, 2, 2), "@", F.substring(mixed, 7, 5), "#", number(3, 2), '"}')),
        (1, cat("https://api.example.com/", word(3), "?token=", hex40)),
        (0, number(1, 16)),
        (0, cat(number(1, 16), " ", F.reverse(number(2, 16)))),
        (0, cat("+1 (", number(3, 3), ") 555-", number(4, 4), "-", number(2, 8))),
        (0, cat(word(7), ".", number(3, 2), "@mail", number(4, 1), ".example.com")),
        (0, cat("version 2.", number(3, 2), ".", number(5, 2), "-", number(7, 8))),
        (0, cat("id ", uuid)),
        (0, cat("commit ", hex40)),
        (0, cat("sha256 checksum ", hex64)),
        (0, cat("https://www.example.com/", word(3), "/", number(3, 6), "/index.html")),
        (0, cat(word(2), "_", word(5), "_", number(3, 4))),
        (0, cat('token = "', F.repeat(number(4, 1), 20), '"')),
        (0, cat('api_key = "your-api-key-here-', number(3, 2), '"')),
        (0, cat("password = ", word(4), "_", word(8), "_password")),
        (0, cat(octet(0), ".", octet(8), ".", octet(16), ".", octet(24))),
        (0, cat("2", octet(5).substr(2, 2), ".2", octet(12).substr(2, 2), ".1", octet(20).substr(2, 2), ".1", octet(28))),
        (0, cat("page=", number(3, 6))),
        (0, cat("time: ", number(3, 2), ":", number(5, 2), ":", number(7, 2))),
        (0, cat('{"', word(3), '":"', word(5), number(3, 2), '","size":"', number(3, 6), '"}')),
        (0, cat(word(2), "=", word(5), number(6, 3))),
        (0, cat(word(1), F.lower(word(9)), number(3, 1), F.lower(word(10)))),
    ]
    pick = F.pmod(F.col("seed"), F.lit(len(kinds))).cast("int")
    chosen = F.element_at(F.array(*[F.struct(F.lit(y).alias("label"), v.alias("text")) for y, v in kinds]), pick + 1)
    parts = F.concat_ws(" ", F.slice("words", 1, 8), "chosen.text", F.slice("words", 9, 8))
    return rows.withColumn("chosen", chosen).select("doc_id", parts.alias("text"), "path", "chosen.label")


def fit_forest(findings: DataFrame, words: DataFrame, trees: int = 25, depth: int = 8, seed: int = 17) -> PipelineModel | None:
    """A forest from labelled findings (``doc_id``, ``text``, ``path``, ``label`` 0 or 1).

    Candidates in a finding's text carry its label. Without candidates of both
    labels there is no forest (None).
    """
    found = described(candidates(findings, "path", ("label",)), words)
    rows = store(
        found.select(F.col("label").cast("double").alias("label"), *FEATURES).repartition(2).sortWithinPartitions(*FEATURES),
        "findings",
    )
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def judged(found: DataFrame, words: DataFrame, forest: PipelineModel | None, secret_at: float = SECRET_AT) -> DataFrame:
    """``candidates`` with the forest's ``score`` and ``is_secret``; without a forest all are secrets."""
    if forest is None:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    scored = forest.transform(described(found, words))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.withColumn("score", score).select(
        *found.columns, "score", (F.col("score") >= secret_at).alias("is_secret")
    )


def scan_secrets(
    docs: DataFrame, words: DataFrame, forest: PipelineModel | None, path_column: str | None = None,
    secret_at: float = SECRET_AT,
) -> DataFrame:
    """Every candidate with its verdict: ``doc_id``, ``word_at``, ``value``, ``score``, ``is_secret`` and context.

    Whole texts are read; null and empty texts have no candidates; repeated
    rows give their candidates each; other columns are ignored; no documents,
    no rows.
    """
    return judged(candidates(docs, path_column), words, forest, secret_at)


def _masked_word(word: Column, before: Column, hit: Column, mask: str) -> Column:
    """The word with the values of the parts at the places ``hit`` masked."""

    def one(part: Column, at: Column) -> Column:
        closing = F.regexp_extract(part, r"[.\-]*$", 0)
        return F.when(F.array_contains(hit, at), F.concat(F.lit(mask), closing)).otherwise(part)

    joined = F.array_join(F.transform(_parts(word, before), one), "")
    return F.substring(joined, F.when(_behind(before), 2).otherwise(1), F.length(word) + F.size(hit) * len(mask) + 1)


def _masked_text(text: Column, places: Column, mask: str) -> Column:
    """The text with the words at ``places`` (``word_at``, ``hit``; ascending) masked, all else as it was.

    What lies between two such words is cut out once, so the time grows with the text.
    """

    def rebuilt(words: Column, gaps: Column, tokens: Column) -> Column:
        def upto(place: Column, k: Column) -> Column:
            at, start = place["word_at"], F.coalesce(F.get(places, k - 1)["word_at"] + 1, F.lit(0))
            word = _masked_word(F.get(words, at), _near(words, at - 1), place["hit"], mask)
            kept = F.array_join(F.slice(tokens, start + 1, at - start), "")
            return F.concat(kept, word, F.coalesce(F.get(gaps, at), F.lit("")))

        rest = F.slice(tokens, F.element_at(places, -1)["word_at"] + 2, F.size(tokens))
        return F.concat(F.array_join(F.transform(places, upto), ""), F.array_join(rest, ""))

    def joined(words: Column, gaps: Column) -> Column:
        whole = F.zip_with(words, gaps, lambda word, gap: F.concat(word, F.coalesce(gap, F.lit(""))))
        return let(whole, lambda tokens: rebuilt(words, gaps, tokens))

    gaps = F.regexp_extract_all(text, F.lit(f"({SPACES})"), F.lit(1))
    return let(F.split(text, SPACES), lambda words: let(gaps, lambda g: joined(words, g)))


def redact_secrets(
    docs: DataFrame, words: DataFrame, forest: PipelineModel | None, path_column: str | None = None,
    secret_at: float = SECRET_AT, mask: str = MASK, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` with every confirmed secret in ``text`` replaced by ``mask``; all rows and columns stay.

    Masked are the places of confirmed secrets, and of other candidates of the same text with the
    same value; a longer word that contains the value stays. Only texts with a confirmed secret
    are joined with their places, by a hash of text and path; the others pass by. Places are
    broadcast if they take at most ``broadcast_bytes``, counted. A null text stays null; repeated rows
    are masked alike; no documents, no rows.
    """
    text, where = whole_text(docs), (docs[path_column].cast("string") if path_column else F.lit(""))
    key = fresh(docs, "secret_key")
    keyed = docs.withColumn(key, F.xxhash64(text, where))
    found = judged(candidates(keyed, path_column, (key,)), words, forest, secret_at)
    # Copies of a text have the same places, so a group holds no more than a text's own.
    alike = found.groupBy(F.col(key).alias("found_key"), "value").agg(
        F.max("is_secret").alias("is_secret"), F.collect_set(F.struct("word_at", "part_at")).alias("at")
    )
    hits = alike.filter("is_secret").select("found_key", F.explode("at").alias("at"))
    hits = hits.groupBy("found_key", "at.word_at").agg(F.collect_list("at.part_at").alias("hit"))
    places = fresh(docs, "secret_places")
    secrets = hits.groupBy(F.col("found_key").alias(f"{key}_")).agg(
        F.array_sort(F.collect_list(F.struct("word_at", "hit"))).alias(places)
    )
    secrets = store(secrets, "secrets")
    hit_words, hit_parts = F.size(places), F.size(F.flatten(F.col(f"{places}.hit")))
    (size,) = secrets.agg(F.sum(64 + 64 * hit_words + 8 * hit_parts)).first()
    # Places are stored in far fewer bytes than they take: Spark is not to go by those.
    secrets = F.broadcast(secrets) if (size or 0) <= broadcast_bytes else secrets.hint("merge")
    met = keyed.join(secrets, F.col(key) == F.col(f"{key}_"), "left")
    clean = _masked_text(F.col("`text`"), F.col(places), mask)
    redacted = F.when(F.col(places).isNull(), F.col("`text`")).otherwise(clean)
    return met.select(*[redacted.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
