"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import embedding_search

    return embedding_search(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "neighbour_id", "distance")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_dedup.*", F.sha2("text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), batches=2)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill, restore

    x = F.col("infill")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    about = [x[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    return infill(table(spark, sf_dir, "documents")).select("doc_id", *about, sha(x["output"]).alias("output_sha256"), sha(restore(x["output"], x["form"])).alias("restored_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_id

    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_hamming_top_k,
        op3_simhash_near_dedup,
        op4_source_mix,
        op5_substring_dedup,
        op6_toxicity_classifier,
        op7_line_dedup,
        op8_best_fit_packing,
        op9_license_scan,
        op10_exact_dedup,
        op11_fill_in_middle,
        op12_lexical_search,
        op13_language_id,
    )
}

SQL = {
    "op2_hamming_top_k": """
        WITH c AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS bits FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
                     CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
              FROM c q JOIN c v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10""",
    "op7_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        p AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
        w AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM p),
        m AS (SELECT x.doc_id, y.doc_id AS earlier, x.i, x.i - y.i AS gap, x.words FROM w x JOIN w y ON x.line = y.line AND (y.doc_id, y.i) < (x.doc_id, x.i)),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, earlier, gap ORDER BY i) AS run FROM m),
        r AS (SELECT doc_id, min(i) AS b, max(i) + 1 AS e FROM g GROUP BY doc_id, earlier, gap, run HAVING sum(words) >= 5),
        x AS (SELECT doc_id, max(e - b) AS longest_run FROM r GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(b, e)) AS i FROM r),
        k AS (SELECT p.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p.i) FILTER (WHERE gone.i IS NULL), '') AS kept
              FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(kept) AS kept_sha256
        FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN x ON d.doc_id = x.doc_id""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', doc_id)) AS h FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS a,
                     CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2,
                     CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(a) AS n, least(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS x, greatest(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS y,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT doc_id, text, n, form, array_to_string(a[1:x], '') AS prefix, array_to_string(a[x+1:y], '') AS middle, array_to_string(a[y+1:], '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op12_lexical_search": """
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        l AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
        t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, l GROUP BY term, big_n),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
              FROM i JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), l GROUP BY item_id, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
}
