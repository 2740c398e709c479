"""Inputs derived from the given tables by SQL that Spark and DuckDB both run.

They turn orders, line items, customers, suppliers and parts into works, scorings, composers and years, so that every
query's work grows with the tables, and say in columns what a text was made of.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Numbered works: an order of a customer. n runs through the customer's orders; every fifth year is hidden.
WORKS = """
SELECT ord, concat('c', cust) AS c, n,
  concat(form, ' No. ', n, CASE WHEN ord % 4 = 1 THEN ' in C major' WHEN ord % 4 = 2 THEN ' (ballet)' ELSE '' END) AS t,
  CASE WHEN ord % 3 = 0 THEN concat('Op. ', n) WHEN ord % 3 = 1 THEN concat('BWV ', ord) END AS cat,
  CASE WHEN ord % 5 < 3 THEN NULL ELSE CAST(yr AS INT) END AS y, ord % 7 = 0 AS arr, ord % 9 = 0 AS est, form
FROM (SELECT o_orderkey AS ord, o_custkey AS cust, year(o_orderdate) AS yr,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Symphony' WHEN o_orderkey % 3 = 1 THEN 'Piano Concerto' ELSE 'Suite' END AS form,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o
"""

#: The parts of an order's scoring: instrument i (0-3 in the family, 4 another, 5 and 6 out of scope), number q, way of writing f.
PARTS = """
SELECT l_orderkey AS ord, l_linenumber % 7 AS i, CAST(min(l_quantity) AS INT) % 12 + 1 AS q, (l_orderkey + l_linenumber) % 4 AS f
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

_ONE = "CASE i WHEN 0 THEN 'piccolo trumpet' WHEN 1 THEN 'trumpet' WHEN 2 THEN 'cornet' WHEN 3 THEN 'flugelhorn' WHEN 4 THEN 'oboe' WHEN 5 THEN 'bass trumpet' ELSE 'cornetto' END"

SEGMENTS = f"""
SELECT ord, i, q, f, CASE f WHEN 0 THEN concat(q, ' ', name, 's') WHEN 1 THEN CASE WHEN q > 1 THEN concat(name, ' 1-', q) ELSE name END
  WHEN 2 THEN concat(q, ' B-flat ', name, 's') ELSE concat(name, 's') END AS segment
FROM (SELECT ord, i, q, f, {_ONE} AS name FROM ({PARTS}) p) s
"""

SPARK_TEXTS = f"SELECT ord, array_join(transform(array_sort(collect_list(struct(i, segment))), x -> x.segment), ', ') AS text FROM ({SEGMENTS}) GROUP BY ord"
DUCK_TEXTS = f"SELECT ord, string_agg(segment, ', ' ORDER BY i) AS text FROM ({SEGMENTS}) GROUP BY ord"

_COUNT = "CASE WHEN f = 3 THEN 2 ELSE q END"
#: What DuckDB expects of the parser, from the columns the text was made of.
COUNTS = f"""
SELECT ord, {', '.join(f"CAST(coalesce(sum(CASE WHEN i = {i} THEN {_COUNT} END), 0) AS INT) AS n{i}" for i in range(4))},
  CAST(coalesce(sum(CASE WHEN i < 4 THEN {_COUNT} END), 0) AS INT) AS total, CAST(count(CASE WHEN i < 4 AND f = 3 THEN 1 END) AS INT) AS guessed
FROM ({PARTS}) p GROUP BY ord
"""

#: Composer records of two ranked sources: customers by name, suppliers under the names of customers, some with a variant spelling.
PEOPLE = """
SELECT CAST(0 AS INT) AS rank, c_custkey AS ord, concat('Maria ', word, ' Kund', c_custkey % 100) AS name, CASE WHEN c_custkey % 10 = 0 THEN concat('id-', c_custkey) END AS id, CASE WHEN c_custkey % 4 = 0 THEN '1810–1856' END AS dates
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ána' WHEN c_custkey % 3 = 1 THEN 'Ana' ELSE 'Bea' END AS word FROM customer) a
UNION ALL
SELECT CAST(1 AS INT), s_suppkey, concat('maria ana  kund', s_suppkey % 100), NULL, CASE WHEN s_suppkey % 3 = 0 THEN '1900–' END FROM supplier
"""

#: Two ranked sources of titles that partly agree.
RANKED = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 1 ELSE 2 END AS rank, o_orderkey AS ord, concat('c', o_custkey % 50) AS c,
  concat(p_name, CASE WHEN o_orderkey % 2 = 0 THEN ' in C major' ELSE ', for the' END) AS t, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS INT) END AS y
FROM orders JOIN part ON p_partkey = o_orderkey % 200
"""

#: Fields that hold years, made of order dates; the rest says what should be read.
YEAR_FIELDS = """
SELECT o_orderkey AS ord, yr, CASE o_orderkey % 6 WHEN 0 THEN concat('composed ', yr) WHEN 1 THEN concat(yr - 3, '–', yr) WHEN 2 THEN concat(yr - 1, '-', lpad(CAST(yr % 100 AS VARCHAR(9)), 2, '0'))
  WHEN 3 THEN concat(yr, '–', yr - 5) WHEN 4 THEN 'undated' ELSE concat(yr - 5, '–', yr - 1, '/', lpad(CAST(yr % 100 AS VARCHAR(9)), 2, '0')) END AS text
FROM (SELECT o_orderkey, year(o_orderdate) AS yr FROM orders) o
"""

TABLES = ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs one of the statements above over the tables of `sf_dir`; no name is left behind in the session."""
    pattern = rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b"
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in {m[2] for m in re.finditer(pattern, sql)}}
    return spark.sql(re.sub(pattern, r"\1 {\2}", sql), **frames)
