"""The thin queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, langid, licenses, line_dedup, merkle, pieces, pii, sharding, simhash, token_files, toxicity
from .common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_files.written(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.lower(F.sha2(F.array_join("items", ",").cast("binary"), 256))
    return found.select(F.col("__id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), sharding.tree(8), sharding.tree(9))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.decisions(table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~held_out(labels["doc_id"]))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_model())


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda d: F.pmod(F.crc32(d.cast("string").cast("binary")), F.lit(5)) == 0
    found = langid.predictions(docs, langid.sample(docs, ~fold(docs["doc_id"])))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_langid": op12_langid,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op6_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win
                     FROM i, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s(k) WHERE len(w) > 0),
             sizes AS (SELECT DISTINCT n FROM win),
             pos AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS s(k) WHERE len(w) >= n),
             hit AS (SELECT doc_id, item_id, k, p.n FROM pos p JOIN win USING (n, win)),
             per AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(k, k + n)) AS u(q) GROUP BY doc_id),
             its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op13_merkle": r"""
        WITH RECURSIVE f AS (SELECT doc_id, coalesce('s' || source, '') AS key, text,
                 coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                 || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                 list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT)),
                     lambda c, b: list_reduce(range(0, 8), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), CAST(4294967295 AS BIGINT)) AS crc
             FROM documents),
             d AS (SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
                      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered FROM f),
             l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d),
             t(key, level, pos, n, h) AS (SELECT key, 0, pos, n, leaf FROM l UNION ALL
                 SELECT key, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY key, level, n, pos // 3),
             s AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
             r(level, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s UNION ALL
                 SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY level, n, pos // 3),
             sibs AS (SELECT l.key, l.pos, 0 AS tree, t.level, t.pos AS q, t.h FROM l JOIN t ON t.key = l.key AND t.n > 1 AND t.pos // 3 = l.pos // CAST(pow(3, t.level + 1) AS BIGINT) AND t.pos <> l.pos // CAST(pow(3, t.level) AS BIGINT)
                 UNION ALL SELECT l.key, l.pos, 1, r.level, r.pos, r.h FROM l JOIN s USING (key) JOIN r ON r.n > 1 AND r.pos // 3 = s.pos // CAST(pow(3, r.level + 1) AS BIGINT) AND r.pos <> s.pos // CAST(pow(3, r.level) AS BIGINT)),
             proof AS (SELECT key, pos, sha256(string_agg(h, '' ORDER BY tree, level, q)) AS proof FROM sibs GROUP BY key, pos),
             up(key, leaf, level, pos, h, n) AS (SELECT key, pos, 0, pos, tampered, n FROM l UNION ALL
                 SELECT u.key, u.leaf, u.level + 1, u.pos // 3, sha256(string_agg(CASE WHEN t.pos = u.pos THEN u.h ELSE t.h END, '' ORDER BY t.pos)), (u.n + 2) // 3
                 FROM up u JOIN t ON t.key = u.key AND t.level = u.level AND t.pos // 3 = u.pos // 3 WHERE u.n > 1 GROUP BY u.key, u.leaf, u.level, u.pos, u.n),
             on_top(key, leaf, level, pos, h, n) AS (SELECT up.key, leaf, 0, s.pos, up.h, s.n FROM up JOIN s ON s.key = up.key WHERE up.n = 1 UNION ALL
                 SELECT u.key, u.leaf, u.level + 1, u.pos // 3, sha256(string_agg(CASE WHEN r.pos = u.pos THEN u.h ELSE r.h END, '' ORDER BY r.pos)), (u.n + 2) // 3
                 FROM on_top u JOIN r ON r.level = u.level AND r.pos // 3 = u.pos // 3 WHERE u.n > 1 GROUP BY u.key, u.leaf, u.level, u.pos, u.n)
        SELECT doc_id, l.leaf, subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, o.h AS folded_root, o.h = root.h AS verified
        FROM l JOIN s USING (key) JOIN (SELECT h FROM r WHERE n = 1) root ON true JOIN on_top o ON o.key = l.key AND o.leaf = l.pos AND o.n = 1
        LEFT JOIN proof ON proof.key = l.key AND proof.pos = l.pos""",
}
