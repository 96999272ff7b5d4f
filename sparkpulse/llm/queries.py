"""The corpus operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, decontam, html_extract, line_dedup, merkle, near_dedup, quality, runs, secret_scan, sharding, token_counts, warc
from .common import scratch_path, table, written


#: Tasks that the copies of one text are dealt out over.
SALTS = 32
#: Limit of one shard in the query: small enough that the smallest given tables are split too.
QUERY_SHARD_BYTES = 128 * 1024


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_and_rank_counters() -> dict:
    """Two tokenizer versions: words between white space, and a byte-level vocabulary of merge ranks."""
    import public_tokenizers

    return {"words/1": token_counts.word_counter, "byte_bpe_50k/1": token_counts.rank_file_counter(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in; the same batch comes again; later exact copies are retired."""
    docs = table(spark, sf_dir, "documents")
    ledger = token_counts.TokenLedger(spark, scratch_path(spark, "token-ledger"), word_and_rank_counters())
    load = docs.select("doc_id", F.lit("insert").alias("op"), "source", "lang", "text")
    ledger.commit("load", load)
    ledger.commit("load", load)
    first = docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("print")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a group of copies is dealt out over SALTS tasks
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("print"), F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt")).join(salted, ["print", "salt"]).where("doc_id <> first")
    ledger.commit("retire-copies", copies.select("doc_id", F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")]))
    return ledger.totals()


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "removed_chunks")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (quality.remainder(F.col("doc_id")) == 2).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), QUERY_SHARD_BYTES)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.digest(runs.find_runs(docs))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), root)
    found = written(warc.summary(warc.read_archive(spark, root)), "warc-records")
    warc.delete_archive(spark, root)
    return found


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spoiled = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, changed=("text", spoiled), kept=merkle.verified)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_avi": op5_avi,
    "op6_html": op6_html,
    "op7_sharding": op7_sharding,
    "op8_decontam": op8_decontam,
    "op9_secrets": op9_secrets,
    "op10_near_dedup": op10_near_dedup,
    "op11_runs": op11_runs,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    # the leaf of a row is the shortest prefix of its hash whose rows fit the limit, or the whole hash
    "op7_sharding": f"""
        WITH sized AS (
          SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
          FROM documents),
        levels AS (SELECT s.doc_id, s.n_bytes, d.depth::INT AS depth, (h >> (60 - d.depth::INT)) AS prefix
                   FROM sized s, range(0, 61) d(depth)),
        sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM levels GROUP BY ALL),
        placed AS (SELECT l.doc_id, l.n_bytes, l.depth, l.prefix, s.shard_bytes,
                          row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k
                   FROM levels l JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {QUERY_SHARD_BYTES} OR depth = 60)
        SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes
        FROM placed WHERE k = 1""",
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        s AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
                     max(page_id) OVER (PARTITION BY body) AS last FROM p),
        r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AS revisit FROM s)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisit THEN last END AS refers_to FROM r""",
    # levels of nodes from the leaves up, then each leaf's siblings level by level; CRC-32 bit by bit
    "op13_merkle": """
        WITH RECURSIVE d AS (
          SELECT doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce(
            list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
            lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
            4294967295::BIGINT)) % 2 = 0 AS hit FROM documents),
        f AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
            replace(text, chr(10), '') AS other FROM d),
        h AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
            CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) END AS changed FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM h),
        up AS (SELECT 0 AS level, source, pos, leaf AS node, size FROM p
            UNION ALL SELECT level + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (size + 2) // 3 FROM up WHERE size > 1 GROUP BY level, source, pos // 3, size),
        s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM up WHERE size = 1),
        top AS (SELECT 0 AS level, pos, subroot AS node, size FROM s
            UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (size + 2) // 3 FROM top WHERE size > 1 GROUP BY level, pos // 3, size),
        low AS (SELECT p.source, p.pos, u.level, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < p.pos // (3 ** u.level)::BIGINT), '') AS l,
            coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > p.pos // (3 ** u.level)::BIGINT), '') AS r
            FROM p JOIN up u ON u.source IS NOT DISTINCT FROM p.source AND u.size > 1 AND u.pos // 3 = p.pos // (3 ** (u.level + 1))::BIGINT GROUP BY ALL),
        high AS (SELECT s.source, t.level + 1000 AS level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (3 ** t.level)::BIGINT), '') AS l,
            coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (3 ** t.level)::BIGINT), '') AS r
            FROM s JOIN top t ON t.size > 1 AND t.pos // 3 = s.pos // (3 ** (t.level + 1))::BIGINT GROUP BY s.source, s.pos, t.level),
        step AS (SELECT source, pos, level, l, r FROM low UNION ALL SELECT p.source, p.pos, level, l, r FROM p JOIN high ON p.source IS NOT DISTINCT FROM high.source),
        path AS (SELECT source, pos, list({'l': l, 'r': r, 'h': ''} ORDER BY level) AS steps FROM step GROUP BY ALL),
        full_rows AS (SELECT p.*, subroot, (SELECT node FROM top WHERE size = 1) AS root, coalesce(steps, []) AS steps
            FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN path ON path.source IS NOT DISTINCT FROM p.source AND path.pos = p.pos)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
            list_reduce(steps, lambda a, x: {'l': '', 'r': '', 'h': sha256(x.l || a.h || x.r)}, {'l': '', 'r': '', 'h': coalesce(changed, leaf)}).h AS folded_root, folded_root = root AS verified FROM full_rows""",
}
