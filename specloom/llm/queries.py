"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specloom.llm.bag_search import rank_documents
from specloom.llm.bin_packing import pack_documents
from specloom.llm.decontamination import find_overlaps
from specloom.llm.exact_dedup import mark_files
from specloom.llm import hnsw, language_id
from specloom.llm.ngram_join import link_documents
from specloom.llm.periodic_runs import collapse_runs
from specloom.llm.sentence_pieces import decode_pieces, encode_as_trained
from specloom.llm.suffix_dedup import remove_repeats
from specloom.llm.token_counts import count_tokens
from specloom.llm.token_files import read_documents, write_token_files
from specloom.llm.url_filter import Rule, filter_urls
from specloom.session import scratch_path, settled

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
SEQUENCE_TOKENS = 1024
URL_RULES = [
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build_index(vectors, neighbours=5), vectors.where("vec_id % 50 = 0"), neighbours=5)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.learn(docs.where(~held_out()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_model(docs)).withColumn("held_out", held_out())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=100).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID, SEQUENCE_TOKENS)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_files(spark, [f"{sf_dir}/documents.parquet"])
    return marked.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), END_ID)
    return read_documents(spark, path, checksum=True)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded as the model was trained, and decoded again; equal digests of text and decoded text show the round trip."""
    model = public_tokenizers.path(PIECES)
    decoded = decode_pieces(encode_as_trained(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select(
        "doc_id", "n_tokens", "ids_crc32", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), in which every tenth text or so, by its id's hash, repeats some of its words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Words are taken out of the texts that are changed, and no others; past ``settled`` they are not worked out again.
    split = settled(docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h")).select(
        "doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words")
    ))
    n = F.size("words")
    placed = settled(split.select(
        "doc_id", "text", "words", n.alias("n"), F.when(n > 0, F.col("g") % n).alias("a"), "g"
    )).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_planted_runs(_table(spark, sf_dir, "documents")), least=24, periods=3)
    # Runs come by start, then period; of equal exponents the first one stays.
    best = F.expr("""
        reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
               (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))
    """)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=20)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest_neighbours": op1_nearest_neighbours,
        "op2_language_id": op2_language_id,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_url_filters": op5_url_filters,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_ngram_join": op7_ngram_join,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_token_files": op9_token_files,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_decontamination": op11_decontamination,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lexical_search": op13_lexical_search,
    }


SQL: dict[str, str] = {
    "op7_ngram_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM worded
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
        ), reached(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT y, root FROM reached JOIN links ON x = reached.doc_id
        ), roots AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
        SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN roots USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), grouped AS (
            SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM normal
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
    """,
    "op5_url_filters": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(r, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path
            FROM rest
        ), rules(rule, rule_host, rule_path, rule_verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), judged AS (
            SELECT page_id, host, path, rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS place
            FROM parts LEFT JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM judged WHERE place = 1
    """,
    "op11_decontamination": r"""
        WITH worded AS (
            SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), words AS (
            SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM worded
        ), windows AS (
            SELECT DISTINCT id AS item_id, size, array_to_string(w[i : i + size - 1], ' ') AS g
            FROM (SELECT id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
                  FROM words WHERE kind = 1 AND len(w) > 0)
        ), places AS (
            SELECT id AS doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
            FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM words, (SELECT DISTINCT size FROM windows) WHERE kind = 0 AND len(w) >= size)
        ), found AS (
            SELECT doc_id, item_id, size, i FROM places JOIN windows USING (size, g)
        ), hits AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
        )
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits ON hits.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE kind = 0
    """,
    "op13_lexical_search": r"""
        WITH terms AS (
            SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
        ), tf AS (
            SELECT kind, id, t, count(*) AS tf FROM terms GROUP BY kind, id, t
        ), sizes AS (
            SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE kind = 0 GROUP BY id
        ), whole AS (
            SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes
        ), lengths AS (
            SELECT id, 100 - 25 + (25 * n * docs) // l AS m FROM sizes, whole
        ), weights AS (
            SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, whole WHERE kind = 0 GROUP BY t
        ), scores AS (
            SELECT i.id AS item_id, d.id AS doc_id, CAST(sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m))) AS BIGINT) AS score
            FROM tf i JOIN tf d ON i.kind = 1 AND d.kind = 0 AND i.t = d.t JOIN weights ON weights.t = d.t JOIN lengths ON lengths.id = d.id
            GROUP BY i.id, d.id
        ), ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
            FROM scores WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 20
    """,
}
