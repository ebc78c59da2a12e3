"""The registered queries of this subpackage: whole tables in, contracts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import centroids, debruijn, decontaminate, jaccard, kneser_ney, mixing, pii, quality_rules, secrets, sharding, simhash, spelling, substring_sa
from tessera.llm.shared import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_sa.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels")).drop("text", "lang")


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_later(table(spark, sf_dir, "documents")).drop("kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_mixing, op3_secret_scan, op4_sharding, op5_quality_classifier, op6_decontamination, op7_personal_data, op8_quality_rules, op9_span_dedup, op10_simhash, op11_spelling_variants, op12_centroid_clusters, op13_jaccard_join)}


#: Words removed where a window of 20 starts earlier too.
_SPANS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
first AS (SELECT k, min(struct_pack(a := doc_id, b := i)) AS f, count(*) AS n FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (k), unnest(range(0, 20)) AS v(j)
         WHERE n > 1 AND NOT (f.a = doc_id AND f.b = i)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Words in windows of benchmark items, and the items with such windows.
_LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, l.n, i, array_to_string(list_slice(w, i, i + l.n - 1), ' ') AS k FROM d, (SELECT DISTINCT n FROM iw) AS l, unnest(range(1, len(w) - l.n + 2)) AS u(i)),
hit AS (SELECT doc_id, item_id, n, i FROM dw JOIN iw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS v(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_NEAREST = """
d{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT vec_id, c, list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM vec, c{i}) GROUP BY vec_id)"""
_MOVED = """
s{i} AS (SELECT c, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM d{i} JOIN vec USING (vec_id), unnest(range(1, 65)) AS u(p) GROUP BY c, p),
c{j} AS MATERIALIZED (SELECT o.c, coalesce(x.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM s{i} GROUP BY c) x USING (c))"""
#: Three rounds of integer Lloyd's over vectors of unique ids.
_CENTROIDS_SQL = """
WITH vec AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256(concat('1:', vec_id)) AS h, v FROM vec ORDER BY h LIMIT 16)),
""" + ",".join(_NEAREST.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(3)) + "," + _NEAREST.format(i=3) + """
SELECT vec_id, d3.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY d3.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d3 JOIN c3 ON d3.c = c3.c
"""

#: Documents whose sets of 4-word shingles overlap by 85 percent, and what is reachable by such links.
_JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 3), ' ')) AS k FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, list(k) AS ks FROM s GROUP BY doc_id),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY df, k) AS p FROM s JOIN (SELECT k, count(*) AS df FROM s GROUP BY k) USING (k)),
pre AS MATERIALIZED (SELECT f.doc_id, k FROM f JOIN n USING (doc_id) WHERE p <= n - (85 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.k = b.k AND a.doc_id < b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.ks, y.ks)) AS i FROM cand JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b) WHERE 185 * i >= 85 * n),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": _LEAKS_SQL, "op9_span_dedup": _SPANS_SQL, "op12_centroid_clusters": _CENTROIDS_SQL, "op13_jaccard_join": _JACCARD_SQL}
