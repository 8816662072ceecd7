"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlattice.llm.common import read
from textlattice.llm.decontaminate import contamination
from textlattice.llm.exact_substring import substring_dedup
from textlattice.llm.html_main import extract
from textlattice.llm.language import fit, held_out, identify
from textlattice.llm.licenses import license_scan
from textlattice.llm.mixing import DOMAINS, domain, mix
from textlattice.llm.simhash import near_duplicates
from textlattice.llm.suffix_array import suffix_dedup
from textlattice.llm.tiff import as_tiff, tiff_pages
from textlattice.llm.token_counts import token_counts

#: Folder of the public tokenizers' files; only the driver reads it.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.expr("x''"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"))
    d = d.select("doc_id", "n_bytes", F.expr("rpad(raw, CAST(greatest(64, 64 * ceil(n_bytes / 64)) AS INT), x'00')").alias("payload"))
    files = as_tiff(d, "payload", ["doc_id", "n_bytes"])
    files = files.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    p = tiff_pages(files, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return p.select("doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, fit(docs, ~held_out(F.col("doc_id"))), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        model = f.read()
    docs = read(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return token_counts(docs, model, ["doc_id", "n_bytes"], rank_scores=True)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain(F.col("quality"), F.col("toxic")).alias("label"))
    out = mix(read(spark, sf_dir, "documents"), labels)
    names = [F.col("posteriors")[i].alias(f"p_{n}") for i, n in enumerate(sorted(DOMAINS))]
    return out.select("doc_id", "n_tokens", *names, "rate")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_media_columns": op2_media_columns,
    "op4_language_id": op4_language_id,
    "op3_simhash": op3_simhash,
    "op5_suffix_array": op5_suffix_array,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS j FROM d WHERE len(w) >= 13),
        k AS (SELECT doc_id, j, array_to_string(w[j:j + 12], ' ') AS s FROM p),
        f AS (SELECT s, min(doc_id) AS first_doc FROM k GROUP BY s),
        r AS (SELECT DISTINCT doc_id, unnest(range(j, j + 13)) AS j FROM k JOIN f USING (s) WHERE first_doc < doc_id),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
        y AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id),
        z AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.j = r.j GROUP BY x.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bk AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
        bw AS (SELECT item, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM bk)),
        ks AS (SELECT DISTINCT k FROM bw),
        dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, ks WHERE len(w) >= k),
        h AS (SELECT dp.doc_id, dp.j, dp.k, bw.item FROM dp JOIN bw ON bw.k = dp.k AND bw.s = array_to_string(dp.w[dp.j:dp.j + dp.k - 1], ' ')),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM h) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
