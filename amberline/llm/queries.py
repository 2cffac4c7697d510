"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm import decontaminate, grace_dedup, language_id, license_scan, line_dedup, ngram_lm, prefix_bpe, simhash, token_files, warc
from amberline.llm.common import table

WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 2
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), WORD_BPE_END, with_ids=False)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "words_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.membership(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.membership(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluated(table(spark, sf_dir, "documents"))


def licence_files(docs: DataFrame) -> DataFrame:
    """The documents as files below source, language and tens of ids; the first of each ten is its directory's NOTICE."""
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("NOTICE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select(F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 10).cast("string"), name).alias("path"), "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(licence_files(table(spark, sf_dir, "documents")), all_words=True)
    number = lambda c: F.regexp_extract(c, r"(\d+)(\.txt)?$", 1).cast("long")
    return out.select(number("path").alias("doc_id"), "licence", F.round("score", 6).alias("score"), "basis", number("origin").alias("origin"), F.round("margin", 6).alias("margin"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), min_count=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_grace_dedup": op4_grace_dedup,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_lm": op10_ngram_lm,
}
ORACLE: dict[str, str] = {
    # Every run of at most ten lines and at least ten words that an earlier document has too; longer blocks consist of such.
    "op2_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
        l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM d),
        b AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p,
                     len(regexp_extract_all(line, '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS words,
                     len(regexp_extract_all(line, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]')) // 2 AS letters
              FROM l WHERE trim(line, ' ') <> ''),
        w AS (SELECT doc_id, p, list(line) OVER ten AS lines, list(greatest(1, words + letters)) OVER ten AS weights
              FROM b WINDOW ten AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
        n AS (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM w),
        r AS (SELECT doc_id, p, n, array_to_string(lines[1:n], chr(10)) AS run FROM n WHERE list_sum(weights[1:n]) >= 10),
        f AS (SELECT run, min(doc_id) AS first FROM r GROUP BY run),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM r JOIN f USING (run) WHERE first < doc_id),
        cut AS (SELECT b.doc_id, b.i, b.words FROM b JOIN gone ON b.doc_id = gone.doc_id AND b.p = gone.p),
        kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
                 FROM l ANTI JOIN cut ON l.doc_id = cut.doc_id AND l.i = cut.i GROUP BY l.doc_id),
        lost AS (SELECT doc_id, count(*) AS n, sum(words) AS words FROM cut GROUP BY doc_id),
        have AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(have.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(lost.words, 0) AS BIGINT) AS words_removed, sha256(coalesce(kept.text, '')) AS text_sha256
        FROM d LEFT JOIN have USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
                     list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS n
              FROM p)
        SELECT page_id,
               CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda j:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          CAST((n[CAST(j // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d
    """,
    "op4_grace_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               CAST(count(*) OVER same AS BIGINT) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
                FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bl)),
        lens AS (SELECT DISTINCT n FROM bl),
        dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
        m AS (SELECT dw.doc_id, dw.n, dw.s, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
}
