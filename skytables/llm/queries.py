"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import (
    fingerprints, jaccard_join, language_id, license_scans, packing, quality_rules, ranked_search, sentence_pieces, suffix_dedup, token_files,
    url_filter, vector_codes, warc,
)
from .common import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text("sketch").alias("fingerprint"), fingerprints.as_text("edited_sketch").alias("edited_fingerprint"),
        fingerprints.likeness("sketch", "edited_sketch").alias("near_edited"),
        fingerprints.likeness("sketch", "next_sketch").alias("near_next"),
        fingerprints.containment("sketch", "edited_sketch").alias("contained_edited"),
    )


#: The rules of the check (fixed values).
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    judged = url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op10_url_filter"] = r"""
WITH rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, coalesce(strpos(url, '://'), 0) > 0 AS has,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
fits AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
    FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.with_features(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    judged = quality_rules.judge(rows)
    return judged.select("doc_id", *[
        F.col(f"_rule_{c}").alias(c)
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    ])


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    rows = token_files.with_crc32(token_files.read_token_files(spark, files))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, folder, "pages"))
    return read.select(
        F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


ORACLE_SQL["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) // CAST(32 ** (3 - i % 4) AS BIGINT)) % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.train(docs)
    rows = language_id.predict(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
        F.array_join("languages", ",").alias("languages"),
    )


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("_doc.text", F.lit(""))).cast("bigint")
    return rows.select(
        "_doc.doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("_kept")).alias("n_removed"),
        F.size("_removed").cast("bigint").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


@query
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.with_components(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op5_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rows = sentence_pieces.with_crc32(rows.withColumn("text", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))))
    return rows.select(
        "doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "n_byte_pieces", "ids_crc32",
        F.col("text").alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of byte tokens, with an end token after each document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.best_fit(docs, F.octet_length(F.coalesce("text", F.lit(""))) + 1)


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    return ranked_search.search(docs, items).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL["op11_ranked_search"] = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
weights AS (SELECT item_id, term, count(*) * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM asked JOIN df USING (term), corpus GROUP BY item_id, term, docs, df),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
    FROM weights JOIN tf USING (term) JOIN size USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    rows = license_scans.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("_doc.doc_id", *license_scans.summary(rows))


def _license_sql() -> str:
    """Every block against every template, without filters."""
    block, stride, percent = license_scans.BLOCK, license_scans.STRIDE, license_scans.THRESHOLD
    values = ", ".join(
        f"('{t.label}', {str(t.phrase).lower()}, {license_scans.words_of(t.text)!r})" for t in license_scans.PHRASES + license_scans.NOTICES)
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(label, phrase, t) AS (VALUES {values}),
blocks AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - {block}) / {stride}e0) AS BIGINT)) * {stride} + 1, {stride})) AS start FROM words),
met AS (SELECT doc_id, label, len(list_intersect(w[start + 1:start + {block}], t)) / CAST(len(list_distinct(t)) AS DOUBLE) AS share
    FROM blocks, templates WHERE NOT phrase AND 100 * len(list_intersect(w[start + 1:start + {block}], t)) >= {percent} * len(list_distinct(t))),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(t)] = t)) AS word FROM words, templates WHERE phrase),
places_of AS (SELECT doc_id, count(*) AS n, min(word) AS first_word, max(word) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
met_of AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM met GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(p.n, 0) AS n_base, p.first_word, p.last_word,
    array_to_string(list_sort(coalesce(p.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(m.labels, [])))), ',') AS labels,
    greatest(CASE WHEN p.n > 0 THEN 1e0 ELSE 0e0 END, coalesce(m.share, 0e0)) AS score
FROM words LEFT JOIN places_of p USING (doc_id) LEFT JOIN met_of m USING (doc_id)
"""


ORACLE_SQL["op12_license_scans"] = _license_sql()


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows, books = vector_codes.encode(table(spark, folder, "embeddings"))
    rows = vector_codes.with_label_error(saved(rows, "vector-codes"))
    code = F.array_join(F.transform("_code", lambda c: F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0")), "")
    return rows.select(
        "_doc.vec_id", code.alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"),
        F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """All distances of every round; sums in doubles, which are exact at this size."""
    parts, entries, rounds, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT x.vec_id, x.part, arg_min(b.entry, {{'d': list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v), 'e': b.entry}}) AS entry,
    min(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v)) AS d
    FROM x JOIN b{r} b USING (part) GROUP BY x.vec_id, x.part)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT part, entry, pos, floor(sum(c) / count(*)) AS c FROM (
    SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM a{r} JOIN x USING (vec_id, part)) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(c ORDER BY pos) AS v FROM s{r} GROUP BY ALL),
b{r + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * CAST(v AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS p(part)),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
b0 AS (SELECT part, entry, v FROM starts JOIN x USING (vec_id)),{','.join(steps).replace(' AS (', ' AS MATERIALIZED (')},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda c: CAST(c AS BIGINT)), 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""


ORACLE_SQL["op13_vector_codes"] = _codes_sql()
