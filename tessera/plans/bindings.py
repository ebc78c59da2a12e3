"""The tables of the graph, derived from the star schema that is at hand.

Acts are nations, sections are parts, concepts are runs of sixteen parts, queries are customers.  A section cites
whatever follows it in any order: every pair of neighbouring lines is an edge.  Each view is written once as SQL that both Spark and the
oracle understand; everything grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import FILE_FACTOR, table

ACTS = """
SELECT concat('N', n_nationkey) AS act_id, concat(n_name, ' Act') AS act_name, n_name AS short_name,
       CASE WHEN r_name = 'AFRICA' THEN 'Central' ELSE r_name END AS jurisdiction,
       CASE WHEN n_nationkey % 5 = 0 THEN 'repealed' ELSE 'in_force' END AS status,
       concat(1994 + n_nationkey % 8, '-0', 1 + n_nationkey % 9, '-15') AS in_force_from,
       CASE WHEN n_nationkey % 5 = 0 THEN concat('N', (n_nationkey + 1) % 25) ELSE '' END AS repealed_by,
       CASE WHEN n_nationkey % 5 = 0 THEN concat('N', (n_nationkey + 1) % 25, '_S', (n_nationkey + 1) % 25) ELSE '' END AS repeal_authority,
       n_regionkey AS act_priority, n_nationkey AS ord
FROM nation JOIN region ON n_regionkey = r_regionkey
"""
SECTIONS = """
SELECT concat('N', p_partkey % 25, '_S', p_partkey) AS section_id, concat('N', p_partkey % 25) AS act_id, CAST(p_partkey AS VARCHAR(20)) AS section_number,
       p_name AS title, concat_ws(' ', p_name, p_brand, p_type) AS text, p_partkey AS ord
FROM part
"""
CITES = """
SELECT DISTINCT concat('N', a.l_partkey % 25, '_S', a.l_partkey) AS source_section_id, concat('N', b.l_partkey % 25, '_S', b.l_partkey) AS target_section_id
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey
"""
CONCEPTS = """
SELECT concat('C', CAST(floor(p_partkey / 16) AS BIGINT)) AS concept_id, concat(min(lower(p_name)), ' topic ', CAST(floor(p_partkey / 16) AS BIGINT)) AS name, min(p_type) AS description,
       concat('topic ', CAST(floor(p_partkey / 16) AS BIGINT)) AS alias1, concat(min(lower(p_type)), ' ', max(lower(p_name))) AS alias2, CAST(floor(p_partkey / 16) AS BIGINT) AS ord
FROM part GROUP BY CAST(floor(p_partkey / 16) AS BIGINT)
"""
APPLIES = """
SELECT concat('N', p_partkey % 25, '_S', p_partkey) AS section_id, concat('C', CAST(floor(p_partkey / 16) AS BIGINT)) AS concept_id, CASE WHEN p_size <= 10 THEN 'primary' ELSE 'supporting' END AS relevance FROM part
"""
QUERIES = """
SELECT c_custkey AS query_id, concat('C', CAST(floor(c_custkey / 16) AS BIGINT)) AS concept,
       concat('topic ', CAST(floor(c_custkey / 16) AS BIGINT), ', red bolt small economy for ', lower(c_mktsegment), ', section ', c_custkey % 200, CASE WHEN c_custkey % 2 = 0 THEN concat(' of NATION_', c_nationkey % 25, ' act') ELSE '' END) AS raw_query,
       CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN r_name = 'AFRICA' THEN 'Central' ELSE r_name END END AS jurisdiction,
       c_acctbal AS monthly_salary, CAST(c_custkey % 97 AS DOUBLE) / 8 AS years_of_service, concat(1995 + c_custkey % 6, '-', CASE WHEN c_custkey % 4 = 0 THEN '03' ELSE '11' END) AS event_date
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
VIEWS = {"acts": ACTS, "sections": SECTIONS, "cites": CITES, "concepts": CONCEPTS, "applies_to": APPLIES, "queries": QUERIES}
_TABLES = ("region", "nation", "part", "lineitem", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)  # else millions of rows look small enough to broadcast
    sql = VIEWS[name]
    frames = {t: table(spark, sf_dir, t) for t in _TABLES if t in sql}
    for t in sorted(frames, key=len, reverse=True):
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(sql, **frames)


def with_views(sql: str, recursive: bool = False) -> str:
    """Oracle SQL with the views it names in front."""
    named = ", ".join(f"{k} AS ({v.strip()})" for k, v in VIEWS.items() if k in sql)
    return f"WITH {'RECURSIVE ' if recursive else ''}{named}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
