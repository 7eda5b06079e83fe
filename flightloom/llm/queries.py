"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm import decontamination, language, mixing, ngram_join, pseudonyms, quality, secret_scan, sstable, toxicity, warc
from flightloom.llm._io import table


#: Setting with the secret of the pseudonyms. Without it the query takes a public key, so that test runs agree: anyone can undo those.
KEY_SETTING, PUBLIC_KEY = "spark.flightloom.pseudonyms.key", "public, for tests"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, PUBLIC_KEY).encode())


def op2_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scanned(docs, secret_scan.Grammar(secret_scan.labelled_sample(docs)))


def op3_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op4_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.labelled(docs, language.trained(docs))


def op6_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(spark, table(spark, sf_dir, "documents"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.sum("windows").alias("windows"))


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("host")


def op9_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_feistel_pseudonyms, op2_grammar_secrets, op3_nbsvm_toxicity, op4_warc_reader, op5_crf_language, op6_sstable_tokens, op7_simhash_decontamination, op8_host_quality, op9_weighted_mixing, op10_ngram_jaccard, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op4_warc_reader": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
        FROM m""",
    "op8_host_quality": rf"""
        WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
        dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (
                  SELECT doc_id, l, count(*) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
        win AS (SELECT doc_id, i, w[i:i+4] AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
        again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM again, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
        c AS (SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, n_symbols * 10 > word_chars AS r3, n_dup_lines > 2 AS r4 FROM c),
        h AS (SELECT host, count(*)::DOUBLE AS n, unnest([{{'r': 1, 'x': sum(r1::INT)}}, {{'r': 2, 'x': sum(r2::INT)}}, {{'r': 3, 'x': sum(r3::INT)}}, {{'r': 4, 'x': sum(r4::INT)}}], recursive := true) FROM f GROUP BY host),
        p AS (SELECT r, count(*) AS h, sum(n) AS n, sum(n * n) AS nn, sum(x) / sum(n) AS m, sum(x * x / n) AS q FROM h GROUP BY r),
        s AS (SELECT r, m, CASE WHEN m * (1 - m) > 0 AND n - nn / n - (h - 1) > 0 THEN ((q - n * m * m) / (m * (1 - m)) - (h - 1)) / (n - nn / n - (h - 1)) ELSE 0 END AS rho FROM p),
        k AS (SELECT r, m, CASE WHEN rho <= 0 THEN 1e6 WHEN rho >= 1 THEN 0 ELSE least(1e6, 1 / rho - 1) END AS k FROM s),
        v AS (SELECT host, string_agg(CASE WHEN 1 - (x + k * m) / (n + k) < 5e-1 * (1 - m) THEN ['few_words', 'repeated_words', 'symbols', 'repeated_lines'][r] END, ',' ORDER BY r) AS reasons FROM h JOIN k USING (r) GROUP BY host)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed, NOT (r1 OR r2) AND reasons IS NULL AS kept, coalesce(reasons, '') AS host_reasons
        FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host""",
    "op9_weighted_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, coalesce(text, '') AS text,
                          (('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
        q AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE,
                     1.0::DOUBLE - (length(text) - length(translate(text, '#*$%&|<>', ''))) * 10.0::DOUBLE / length(text)) ELSE 0.05::DOUBLE END) AS key FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
        w AS (SELECT *, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM s),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
              FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        o AS (SELECT arg_min(level, (cap::DOUBLE / w, source)) AS open FROM l WHERE level * w <= cap),
        g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(open * w, cap::DOUBLE)) AS target FROM l, o),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS epochs FROM g),
        p0 AS (SELECT q.*, source_size, target, epochs, target - epochs * source_size AS budget, false AS picked
               FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source),
        p1 AS (SELECT * REPLACE (picked OR now AS picked, budget - coalesce(sum(CASE WHEN now THEN size END) OVER (PARTITION BY source), 0) AS budget) FROM (
               SELECT *, NOT picked AND size <= budget AND sum(CASE WHEN NOT picked AND size <= budget THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS now FROM p0)),
        p2 AS (SELECT * EXCLUDE (now) REPLACE (picked OR now2 AS picked, budget - coalesce(sum(CASE WHEN now2 THEN size END) OVER (PARTITION BY source), 0) AS budget) FROM (
               SELECT *, NOT picked AND size <= budget AND sum(CASE WHEN NOT picked AND size <= budget THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS now2 FROM p1)),
        p3 AS (SELECT * EXCLUDE (now3) REPLACE (picked OR now3 AS picked, budget - coalesce(sum(CASE WHEN now3 THEN size END) OVER (PARTITION BY source), 0) AS budget) FROM (
               SELECT *, NOT picked AND size <= budget AND sum(CASE WHEN NOT picked AND size <= budget THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS now3 FROM p2)),
        p4 AS (SELECT *, NOT picked AND size > 0 AND size < 2 * budget AS may FROM p3),
        p5 AS (SELECT *, picked OR (may AND row_number() OVER (PARTITION BY source, may ORDER BY abs(size - budget), key, doc_id, size) = 1) AS last FROM p4)
        SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (epochs + last::BIGINT) * size ELSE 0 END)::BIGINT AS taken FROM p5""",
    "op10_ngram_jaccard": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 2))) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        linked AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, linked.b FROM r JOIN linked ON linked.a = r.seen)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d
        JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
