"""The registered queries of this package and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseward.llm import (
    exact_dedup,
    fingerprints,
    language_mix,
    lexical_search,
    license_scan,
    line_chunks,
    minhash,
    mixing,
    packing,
    quality_cnn,
    token_rollups,
    url_filters,
    whitening,
)
from pulseward.llm.common import documents
from pulseward.llm.tokens import multilingual_files
from pulseward.session import scratch_path

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


@register
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of near-duplicates it is in."""
    found = minhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "class_size", "kept")


@register
def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the multi-line chunks that stand earlier in the corpus."""
    found = line_chunks.drop_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "text", "n_lines", "removed_chunks", "removed_lines")


@register
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@register
def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_mix.identify(docs, language_mix.fit(docs))


@register
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


@register
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed to shares that follow the square root of a source's characters."""
    return mixing.mix_sources(documents(spark, sf_dir))


@register
def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@register
def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents, those that repeat lines revised, exact copies deleted; one batch comes twice.

    The first batch is counted under two tokenizer versions, the revision under one, and the delete is out of both.
    """
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "llm-rollup")
    rollup, other = token_rollups.Rollup(spark, path), token_rollups.Rollup(spark, path, "byte_bpe_multi_50k", multilingual_files())
    first = docs.withColumn("op", F.lit("upsert"))
    rollup.commit(1, first)
    other.commit(1, first)
    revised = token_rollups.without_repeated_lines(docs).withColumn("op", F.lit("upsert"))
    rollup.commit(2, revised)
    rollup.commit(2, revised)
    copies = exact_dedup.dedup(docs).where("not kept").select("doc_id")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")]
    rollup.commit(3, copies.select("doc_id", *nothing, F.lit("delete").alias("op")))
    return rollup.totals()


@register
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.score(docs, model)


@register
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


#: Rules that decide by host and path, and words that block a URL no such rule fits. Fixed values.
HOST_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
BLOCKED_WORDS = ["bets", "casino", "jackpot", "loans", "pills", "poker", "porn", "viagra"]


@register
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: by the host rules, else by words that stand alone anywhere in host or path."""
    listed = [(p, a, 1) for p, a in HOST_RULES] + [(f"*^{w}^", "block", 0) for w in BLOCKED_WORDS]
    rules = spark.createDataFrame(listed, "pattern string, action string, rank int")
    found = url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    by_rank = lambda rank: F.when(F.col("rank") == rank, F.col("pattern"))
    return found.select("page_id", "host", "path", by_rank(1).alias("rule"), "verdict", by_rank(0).alias("pattern"), "fitted")


@register
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql() -> dict[str, str]:
    return {
        "op11_url_filters": r"""
            WITH cut AS (
                SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
            ), split AS (
                SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                FROM cut
            ), fits AS (
                SELECT *, starts_with(path, '/en/') AS en,
                       [w FOR w IN ['bets', 'casino', 'jackpot', 'loans', 'pills', 'poker', 'porn', 'viagra']
                        IF regexp_matches(host || path, '(?s)^(.*)([^A-Za-z0-9]|^)' || w || '([^A-Za-z0-9]|$)')] AS words
                FROM split
            ), ruled AS (
                SELECT *, [x FOR x IN [
                    CASE WHEN en AND (host = 'www.example.com' OR suffix(host, '.www.example.com')) THEN 'www.example.com/en/' END,
                    CASE WHEN en AND (host = 'example.com' OR suffix(host, '.example.com')) THEN 'example.com/en/' END,
                    CASE WHEN starts_with(path, '/es/') AND (host = 'net' OR suffix(host, '.net')) THEN 'net/es/' END,
                    CASE WHEN starts_with(path, '/fr/') AND (host = 'net' OR suffix(host, '.net')) THEN 'net/fr/' END,
                    CASE WHEN starts_with(path, '/') AND (host = 'com' OR suffix(host, '.com')) THEN 'com/' END
                ] IF x IS NOT NULL] AS rules FROM fits
            )
            SELECT page_id, host, path, rules[1] AS rule,
                   CASE WHEN len(rules) = 0 THEN CASE WHEN len(words) > 0 THEN 'block' ELSE 'allow' END
                        WHEN rules[1] IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END AS verdict,
                   CASE WHEN len(rules) = 0 THEN '*^' || list_sort([lpad(CAST(length(w) AS VARCHAR), 2, '0') || w FOR w IN words],
                        'DESC')[1][3:] || '^' END AS pattern,
                   CAST(len(rules) + len(words) AS BIGINT) AS fitted
            FROM ruled
        """,
        "op12_lexical_search": r"""
            WITH words AS (
                SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
            ), tfs AS (
                SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
            ), sizes AS (
                SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY r
            ), whole AS (
                SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes
            ), asked AS (
                SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark
            ), weights AS (
                SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                FROM tfs, whole GROUP BY term
            ), added AS (
                SELECT t.r, t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part
                FROM tfs t JOIN weights USING (term) JOIN sizes s ON t.r = s.r, whole
            ), scored AS (
                SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN added USING (term) GROUP BY ALL
            )
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
        """,
        "op2_line_chunks": r"""
            WITH lines AS (
                SELECT doc_id, i, line, count(*) OVER (PARTITION BY doc_id) AS n,
                       CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h
                FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
            ), rolled AS (
                SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h AS r FROM lines
            ), seeds(seed, multiplier) AS (
                VALUES (SEEDS)
            ), cuts AS (
                SELECT seed, doc_id, i, line, i = n OR (i >= 2 AND ((r * multiplier) % 1073741789) % 2 = 0) AS cut FROM rolled, seeds
            ), numbered AS (
                SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY seed, doc_id ORDER BY i
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM cuts
            ), chunks AS (
                SELECT DISTINCT doc_id, start, size, body FROM (
                    SELECT doc_id, min(i) AS start, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body
                    FROM numbered GROUP BY seed, doc_id, chunk)
                WHERE size >= 2 AND length(trim(replace(body, chr(10), ''), ' ')) > 0
            ), later AS (
                SELECT doc_id, start, size FROM chunks QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1
            ), gone AS (
                SELECT DISTINCT doc_id, unnest(range(start, start + size)) AS i FROM later
            ), marked AS (
                SELECT l.*, g.i IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
            ), edges AS (
                SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM marked
            )
            SELECT d.doc_id,
                   CASE WHEN count(*) FILTER (gone) = 0 THEN any_value(d.text)
                        ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text,
                   count(*) AS n_lines, count(*) FILTER (edge) AS removed_chunks, count(*) FILTER (gone) AS removed_lines
            FROM documents d JOIN edges e USING (doc_id) GROUP BY d.doc_id
        """.replace("(SEEDS)", ", ".join(str(x) for x in enumerate(line_chunks.MULTIPLIERS))),
        "op6_mix_sources": """
            WITH sizes AS (
                SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source
            ), weighed AS (
                SELECT source, sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars AS rate FROM sizes
            ), steps AS (
                SELECT source, CAST(greatest(1, ceil(rate / 16)) AS INT) AS draws, rate FROM weighed
            ), tables AS (
                SELECT source, k, sum(exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1)))
                       OVER (PARTITION BY source ORDER BY k) AS c
                FROM (SELECT source, draws, rate, unnest(range(97)) AS k FROM steps)
            ), numbers AS (
                SELECT doc_id, source, i,
                       CAST('0x' || substr(md5('17:' || doc_id || ':' || i), 1, 12) AS BIGINT) / 281474976710656.0 AS u
                FROM (SELECT doc_id, source, unnest(range(1, draws + 1)) AS i FROM documents JOIN steps USING (source))
            ), counted AS (
                SELECT doc_id, count(*) AS copies FROM numbers n JOIN tables t ON n.source = t.source AND t.c <= n.u
                GROUP BY doc_id
            )
            SELECT doc_id, text, lang, source, n_chars, copy, md5('17:' || doc_id || ':' || copy) AS shuffle_key
            FROM (SELECT d.*, CAST(unnest(range(1, copies + 1)) AS INT) AS copy FROM documents d JOIN counted USING (doc_id))
        """,
        "op10_exact_dedup": r"""
            WITH digests AS (
                SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                FROM documents
            )
            SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = min(doc_id) OVER g AS kept, text_sha256
            FROM digests WINDOW g AS (PARTITION BY text_sha256)
        """,
    }
