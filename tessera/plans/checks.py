"""Registered queries on whole answers, their checks, grounding as a whole, and reading and replacing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, calculators, evaluation, graph_build, grounding, temporal
from tessera.operators.graph_reads import tasks
from tessera.plans import upkeep  # noqa: F401  (its SQL is used here)
from tessera.plans.bindings import view
from tessera.plans.queries import _concepts, _half_up, _nodes, _stems, query, raw_sql
from tessera.sources import readers, snapshots
from tessera.sources.tables import cut, shared_folder, table

# ---- reading and replacing

_RECORDS = (
    "SELECT o_orderkey % 64 AS p, o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 97 = 0 THEN concat('{\"order_id\": ', o_orderkey) WHEN o_orderkey % 89 = 0 THEN concat('{\"order_id\": \"', o_orderpriority, '\"}') "
    "ELSE concat('{\"order_id\": ', o_orderkey, ', \"customer\": ', o_custkey, ', \"more\": []}') END AS value FROM @"
)
_NUMBERED = f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o_orderkey) AS line FROM ({_RECORDS.replace('@', 'orders')}))"


def _record_files(spark: SparkSession, d: str) -> str:
    """All orders as JSON lines in 64 files, some of them blank, cut short, or of a wrong type."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines = spark.sql(_RECORDS.replace("{", "{{").replace("}", "}}").replace("@", "{orders}"), orders=table(spark, d, "orders"))
    lines.repartition("p").sortWithinPartitions("p", "o_orderkey").select("p", "value").write.partitionBy("p").text(path)
    return path


_FILE = "cast(regexp_extract(file, 'p=([0-9]+)', 1) AS bigint) AS p"


@query(f"{_NUMBERED} SELECT x.p, line, x.o_orderkey AS order_id, o_custkey AS customer FROM x JOIN orders USING (o_orderkey) WHERE contains(value, 'more')")
def records_read(spark: SparkSession, d: str) -> DataFrame:
    """Records of JSON lines with the file and line of each."""
    good, _ = readers.read_records(spark, _record_files(spark, d), "order_id bigint, customer bigint")
    return good.selectExpr(_FILE, "line", "order_id", "customer")


@query(f"{_NUMBERED} SELECT p, line, value AS text FROM x WHERE value <> '' AND NOT contains(value, 'more')")
def bad_record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no record, with the file and line of each."""
    _, bad = readers.read_records(spark, _record_files(spark, d), "order_id bigint, customer bigint")
    return bad.selectExpr(_FILE, "line", "text")


@query("SELECT act_id, status, count(section_id) AS n_sections FROM acts LEFT JOIN sections USING (act_id) WHERE status <> 'repealed' GROUP BY act_id, status")
def reloaded_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph loaded whole, then replaced by what is in force; read from the snapshot that holds."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    acts, sections = view(spark, d, "acts"), view(spark, d, "sections")
    graph_build.reload_tables({"acts": acts, "sections": sections, "concepts": view(spark, d, "concepts")}, root)
    live = acts.where("status != 'repealed'")
    graph_build.reload_tables({"acts": live, "sections": sections.join(live.select("act_id"), "act_id", "left_semi")}, root)
    both = snapshots.read_table(spark, root, "acts").join(snapshots.read_table(spark, root, "sections").select("act_id", "section_id"), "act_id", "left")
    return both.groupBy("act_id", "status").agg(F.count("section_id").alias("n_sections"))


# ---- grounding as a whole

#: Longest block two texts share, first in the one and then in the other, and what is left on both sides, again and again.
_BLOCKS = """
piece AS (SELECT gram, term, term AS a, gram AS b FROM pair UNION ALL
  SELECT gram, term, unnest([left(a, i - 1), substr(a, i + l)]), unnest([left(b, j - 1), substr(b, j + l)]) FROM (
    SELECT *, strpos(b, substr(a, i, l)) AS j FROM (SELECT *, x // 1000 AS l, 999 - x % 1000 AS i FROM (
      SELECT *, coalesce(list_max(flatten(list_transform(range(1, len(a) + 1), lambda s: list_transform(range(1, len(a) - s + 2), lambda n: CASE WHEN contains(b, substr(a, s, n)) THEN n * 1000 + 999 - s ELSE 0 END)))), 0) AS x FROM piece WHERE a <> '' AND b <> '')) WHERE l > 0)),
matched AS (SELECT gram, term, sum(x // 1000) AS m FROM (
  SELECT gram, term, coalesce(list_max(flatten(list_transform(range(1, len(a) + 1), lambda s: list_transform(range(1, len(a) - s + 2), lambda n: CASE WHEN contains(b, substr(a, s, n)) THEN n * 1000 + 999 - s ELSE 0 END)))), 0) AS x FROM piece WHERE a <> '' AND b <> '') GROUP BY gram, term)"""
_LETTERS = "len(list_intersect(list_transform(range(1, len({0}) + 1), lambda i: concat(substr({0}, i, 1), len(left({0}, i)) - len(replace(left({0}, i), substr({0}, i, 1), '')))), list_transform(range(1, len({1}) + 1), lambda i: concat(substr({1}, i, 1), len(left({1}, i)) - len(replace(left({1}, i), substr({1}, i, 1), ''))))))"
_ALL_TERMS = "SELECT concept_id, name, ord, 0 AS term_ord, lower(name) AS term FROM concepts UNION ALL SELECT concept_id, name, ord, 1, lower(alias1) FROM concepts UNION ALL SELECT concept_id, name, ord, 2, lower(alias2) FROM concepts"


def _grounded(phrases: str) -> str:
    """SQL of all three stages over phrases (phrase_id, said): ``g`` has phrase_id, name, ord."""
    grams = " UNION ALL ".join(f"SELECT phrase_id, {5 - n} AS block, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS gram FROM words, unnest(range(1, len(w) - {n - 2})) AS u(i) WHERE len(w) >= {n}" for n in (4, 3, 2, 1))
    return f"""+ sw AS (SELECT string_split('{" ".join(T.GROUNDING_STOPWORDS).replace("'", "''")}', ' ') AS stop),
ph AS (SELECT phrase_id, trim(regexp_replace(lower(said), '\\s+', ' ', 'g')) AS phrase FROM ({phrases}) WHERE trim(said) <> ''), tm AS ({_ALL_TERMS}),
pt AS ({_stems("phrase_id", "phrase", "ph")}), tt AS ({_stems("name, ord, term_ord", "term", "tm")}),
one AS (SELECT DISTINCT phrase_id, name, 1 AS stage, CAST(ord AS BIGINT) AS pl FROM ph JOIN tm ON contains(phrase, term)),
np AS (SELECT phrase_id, count(*) AS n_phrase FROM pt GROUP BY phrase_id), nt AS (SELECT name, ord, term_ord, count(*) AS n_term FROM tt GROUP BY name, ord, term_ord),
df AS (SELECT token, count(DISTINCT name) AS df FROM tt GROUP BY token), nm AS (SELECT name, list(token) AS own FROM tt WHERE term_ord = 0 GROUP BY name),
sh AS (SELECT phrase_id, name, ord, term_ord, count(*) AS k, max(length(token)) AS longest, min(df) AS df, min(token) AS one FROM pt JOIN tt USING (token) JOIN df USING (token) GROUP BY ALL),
sc AS (SELECT phrase_id, name, ord, greatest(k::DOUBLE / n_phrase, k::DOUBLE / n_term) AS score FROM sh JOIN np USING (phrase_id) JOIN nt USING (name, ord, term_ord) LEFT JOIN nm USING (name) WHERE longest >= 4 AND (k > 1 OR df <= 2 OR len(own) = 1 AND own[1] = one)),
two AS (SELECT phrase_id, name, 2 AS stage, n AS pl FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY score DESC, ord) AS n FROM (SELECT phrase_id, name, ord, max(score) AS score FROM sc WHERE score >= 0.5 GROUP BY phrase_id, name, ord)) WHERE n <= 3),
words AS (SELECT phrase_id, string_split(phrase, ' ') AS w FROM ph WHERE phrase_id NOT IN (SELECT phrase_id FROM one UNION SELECT phrase_id FROM two)),
gr AS (SELECT phrase_id, gram, row_number() OVER (PARTITION BY phrase_id ORDER BY block, i) AS g FROM ({grams}) WHERE length(gram) >= 5),
lt AS (SELECT term, max_by(name, ord * 8 + term_ord) AS name FROM tm GROUP BY term),
pair AS (SELECT gram, term FROM (SELECT DISTINCT gram FROM gr) JOIN (SELECT DISTINCT term FROM tm) ON 5 * least(len(gram), len(term)) >= 2 * (len(gram) + len(term)) AND 5 * {_LETTERS.format("gram", "term")} >= 2 * (len(gram) + len(term))),
{_BLOCKS.strip()},
near AS (SELECT phrase_id, g, term, 2.0 * m / (len(gram) + len(term)) AS r FROM gr JOIN matched USING (gram) WHERE 2.0 * m / (len(gram) + len(term)) >= 0.8),
three AS (SELECT phrase_id, name, 3 AS stage, min(n) AS pl FROM (SELECT phrase_id, term, row_number() OVER (PARTITION BY phrase_id ORDER BY r DESC, term DESC) AS n FROM (SELECT *, min(g) OVER (PARTITION BY phrase_id) AS g0 FROM near) WHERE g = g0) JOIN lt USING (term) WHERE n <= 2 GROUP BY phrase_id, name),
g AS (SELECT phrase_id, name, row_number() OVER (PARTITION BY phrase_id ORDER BY stage, pl) AS ord FROM (SELECT phrase_id, name, min(struct_pack(stage := stage, pl := pl)).stage AS stage, min(struct_pack(stage := stage, pl := pl)).pl AS pl FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY phrase_id, name))"""


_SAID = (
    "SELECT p_partkey AS phrase_id, CASE p_partkey % 4 WHEN 0 THEN concat(p_type, ' ', p_name) WHEN 1 THEN concat('Please  explain ', left(p_name, length(p_name) - 2), 'x now') WHEN 2 THEN concat('tpic ', CAST(floor(p_partkey / 16) AS BIGINT), ' qqq') ELSE 'nothing of the kind' END AS said FROM {}"
)


@query(_grounded(_SAID.format("part")) + " SELECT phrase_id, name, ord FROM g", recursive=True)
def ground_phrases(spark: SparkSession, d: str) -> DataFrame:
    """All three stages over a phrase for each part: words of the vocabulary, words misspelled, and words of nothing."""
    said = spark.sql(_SAID.format("{part}"), part=table(spark, d, "part"))
    return grounding.ground(said.select("phrase_id", F.col("said").alias("phrase")), _concepts(spark, d)).select("phrase_id", "name", F.col("ord").cast("bigint").alias("ord"))


_PHRASE = {1: "concat('topic ', CAST(floor(query_id / 16) AS BIGINT))", 2: "'xyzzy plugh'"}
_ASKED = (
    f"SELECT query_id * 1000 + 1 AS phrase_id, {_PHRASE[1]} AS said FROM queries WHERE query_id % 4 IN (1, 3) UNION ALL SELECT query_id * 1000 + 2, {_PHRASE[2]} FROM queries WHERE query_id % 4 IN (2, 3) "
    "UNION ALL SELECT query_id * 1000 + 1, raw_query FROM queries WHERE query_id % 4 = 0 UNION ALL SELECT query_id * 1000 + 999, raw_query FROM queries"
)


@query(
    _grounded(_ASKED) + f""", named AS (SELECT phrase_id // 1000 AS query_id, name, min(struct_pack(i := phrase_id % 1000, ord := ord)) AS o FROM g GROUP BY phrase_id // 1000, name),
lost AS (SELECT query_id, {_PHRASE[2]} AS phrase FROM queries WHERE query_id % 4 IN (2, 3) AND query_id * 1000 + 2 NOT IN (SELECT phrase_id FROM g) UNION ALL SELECT query_id, {_PHRASE[1]} FROM queries WHERE query_id % 4 IN (1, 3) AND query_id * 1000 + 1 NOT IN (SELECT phrase_id FROM g) UNION ALL SELECT query_id, raw_query FROM queries WHERE query_id % 4 = 0 AND query_id * 1000 + 1 NOT IN (SELECT phrase_id FROM g))
SELECT query_id, 'grounded' AS kind, name AS what, row_number() OVER (PARTITION BY query_id ORDER BY o) AS ord FROM named UNION ALL SELECT query_id, 'ungrounded', phrase, 0 FROM lost
UNION ALL SELECT query_id, 'warning', 'no concept matched', 0 FROM queries WHERE query_id NOT IN (SELECT query_id FROM named) UNION ALL SELECT query_id, 'warning', concat('no concept matched for: ', string_agg(phrase, ', ' ORDER BY phrase DESC)), 0 FROM lost WHERE query_id IN (SELECT query_id FROM named) GROUP BY query_id""",
    recursive=True,
)
def ground_whole_queries(spark: SparkSession, d: str) -> DataFrame:
    """The phrases of each query and the query itself, grounded; phrases that weren't, and what is to be said of them."""
    q = view(spark, d, "queries").withColumns({"a": F.expr(_PHRASE[1]), "b": F.expr(_PHRASE[2])})
    none = F.array().cast("array<string>")
    which = F.col("query_id") % 4
    asked = q.select("query_id", "raw_query", F.when(which == 1, F.array("a")).when(which == 2, F.array("b")).when(which == 3, F.array("a", "b")).otherwise(none).alias("legal_concepts"))
    grounded, ungrounded, warnings = grounding.ground_queries(asked, _concepts(spark, d))
    zero = F.lit(0).cast("bigint").alias("ord")
    out = grounded.select("query_id", F.lit("grounded").alias("kind"), F.col("name").alias("what"), F.col("ord").cast("bigint").alias("ord"))
    return out.unionByName(ungrounded.select("query_id", F.lit("ungrounded").alias("kind"), F.col("phrase").alias("what"), zero)).unionByName(warnings.select("query_id", F.lit("warning").alias("kind"), F.col("warning").alias("what"), zero))


# ---- amounts and numbers

_YEARS = "(floor(years_of_service) + CASE WHEN years_of_service - floor(years_of_service) > 0.5 THEN 1 ELSE 0 END)::BIGINT"
_GRATUITY, _NOTICE, _LONG = (f"'{x}'" for x in (calculators.GRATUITY_SECTION, calculators.NOTICE_SECTION, calculators.LONG_NOTICE_SECTION))


@query(
    f"+ f AS (SELECT * FROM queries WHERE monthly_salary > 0), n AS (SELECT query_id, {_YEARS} AS n FROM f) "
    f"SELECT query_id, 0 AS ord, 'Gratuity' AS label, {_GRATUITY} AS section_id, CASE WHEN years_of_service >= 5 THEN {_half_up('monthly_salary / 26 * 15 * n', 2)} END AS amount, CASE WHEN years_of_service >= 5 THEN '' ELSE 'Fewer than 5 years: no amount by rule, but exceptions exist.' END AS note FROM f JOIN n USING (query_id) "
    f"UNION ALL SELECT query_id, 1, 'Notice pay (1 month, if not given working notice)', {_NOTICE}, {_half_up('monthly_salary', 2)}, '' FROM f WHERE query_id % 3 = 0 "
    f"UNION ALL SELECT query_id, 2, 'Notice pay (3 months, if not given working notice)', {_LONG}, {_half_up('monthly_salary * 3', 2)}, '' FROM f WHERE query_id % 3 = 1 "
    f"UNION ALL SELECT query_id, 3, 'Retrenchment compensation', {_NOTICE}, NULL, concat('The rule counts days of pay over ', n, ' year(s) but gives no daily rate, so no amount follows.') FROM f JOIN n USING (query_id) WHERE query_id % 3 = 0"
)
def amounts_listed(spark: SparkSession, d: str) -> DataFrame:
    """Every amount that facts, concepts and retrieved sections allow, and those that the law gives no rule for."""
    facts = view(spark, d, "queries")
    concepts = facts.select("query_id", F.explode(F.array(F.lit("gratuity"), F.lit("retrenchment"))).alias("name"))
    other = F.when(F.col("query_id") % 3 == 0, calculators.NOTICE_SECTION).when(F.col("query_id") % 3 == 1, calculators.LONG_NOTICE_SECTION).otherwise("none")
    shown = facts.select("query_id", F.explode(F.array(F.lit(calculators.GRATUITY_SECTION), other)).alias("section_id"))
    return calculators.compute_available(facts, concepts, shown).select("query_id", "ord", "label", "section_id", "amount", "note")


_WORDS = [*T.UNITS.items(), *T.TENS.items()]
_WORD = f"list_extract([{', '.join(f'{w!r}' for w, _ in _WORDS)}], CAST(o_orderkey % {len(_WORDS)} + 1 AS INT))"
_VALUE = f"list_extract([{', '.join(str(v) for _, v in _WORDS)}], CAST(o_orderkey % {len(_WORDS)} + 1 AS INT))"


@query(
    f"SELECT o_orderkey, ({_VALUE})::VARCHAR AS amount, 'day' AS unit FROM orders UNION ALL SELECT o_orderkey, CAST(o_custkey % 90 + 1 AS VARCHAR), 'month' FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '245' ELSE '27' END, 'percent' FROM orders"
)
def quantities_said(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with units in a text for each order, numbers in words included."""
    words = F.array(*[F.lit(w) for w, _ in _WORDS])
    third = F.when(F.col("o_orderkey") % 2 == 0, "two hundred and forty-five per cent").otherwise("Twenty seven percent")
    said = F.concat_ws(" ", F.element_at(words, (F.col("o_orderkey") % len(_WORDS) + 1).cast("int")), F.lit("days and"), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit("calendar months, or"), third)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    orders = orders.repartition(tasks(orders), "o_orderkey")  # a few large files would else be as few tasks
    return orders.select("o_orderkey", F.explode(T.quantities(said)).alias("q")).select("o_orderkey", "q.amount", "q.unit")


# ---- checks of answers

#: An answer for each order; what is wrong with it depends on r.
_SEEDED = "SELECT o_orderkey AS query_id, o_orderkey % 12 AS r, o_custkey % 150 + 1 AS k, concat('N', (o_custkey % 150 + 1) % 25, '_S', o_custkey % 150 + 1) AS cited, CASE WHEN o_custkey % 3 = 0 THEN 'ASIA' END AS hint, o_custkey % 2 AS told FROM {}"
_BODY = (
    "CASE r WHEN 9 THEN '  ' WHEN 8 THEN 'Pay is due.' WHEN 5 THEN concat('See [N3_S3] and [', cited, '(2)]. Not legal advice.') WHEN 6 THEN concat('See [', cited, ']. Not legal advice.') "
    "WHEN 3 THEN concat('Within ', k % 40 + 2, ' working days.', '{nl}This rests on: a law of 99 years. Not legal advice.') WHEN 4 THEN concat('Within ', k % 40 + 3, ' days.', '{nl}Sections checked: 98 years. Not legal advice.') ELSE 'It is so. This is not Legal Advice.' END"
)


def _seeded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    x = cut(spark.sql(_SEEDED.format("{orders}"), orders=table(spark, d, "orders")))
    ids = F.when(F.col("r") == 1, F.array(F.col("cited"), F.lit("N1_S9999999"))).when(F.col("r") == 11, F.array().cast("array<string>")).otherwise(F.array("cited"))
    made = x.select(
        "query_id", F.when(F.col("r") == 7, "rejected").when(F.col("r") == 10, "insufficient_evidence").otherwise("ok").alias("status"), F.expr(_BODY.format(nl="\\n")).alias("final_answer"), ids.alias("verified_section_ids"),
        F.when(F.col("r") == 5, "lawyer").otherwise("citizen").alias("persona"),
    )
    shown = made.join(x.select("query_id", "r"), "query_id").where("r != 2").select("query_id", F.explode("verified_section_ids").alias("section_id"))
    sections = view(spark, d, "sections").select("section_id", F.lit("Time").alias("section_title"), F.expr("concat('pay within ', ord % 40 + 2, ' days of it')").alias("section_text"))
    said = x.select("query_id", F.expr("CASE WHEN told = 0 THEN concat('after ', k % 40 + 3, ' days') ELSE 'when' END").alias("raw_query"))
    failures = evaluation.check_invariants(made, shown, sections, view(spark, d, "acts"), x.select("query_id", F.col("hint").alias("jurisdiction_hint")))
    return {"answers": made, "sections": sections, "failures": failures, "flagged": evaluation.unsourced_numbers(made, sections, said)}


_CHECKED = f"""+ x AS ({_SEEDED.format('orders')}), ids AS (SELECT query_id, r, hint, cited AS id FROM x WHERE r <> 11 UNION ALL SELECT query_id, r, hint, 'N1_S9999999' FROM x WHERE r = 1),
st AS (SELECT ids.*, regexp_extract(id, '^(.*)_S', 1) AS act_id FROM ids),
fails AS (SELECT query_id, 'unknown citation' AS rule, id AS detail FROM ids WHERE id NOT IN (SELECT section_id FROM sections)
UNION ALL SELECT query_id, 'not retrieved', id FROM ids WHERE r = 2
UNION ALL SELECT query_id, 'repealed law', id FROM st JOIN acts USING (act_id) WHERE status = 'repealed'
UNION ALL SELECT query_id, 'other state', id FROM st JOIN acts USING (act_id) WHERE hint IS NOT NULL AND jurisdiction <> 'Central' AND jurisdiction <> hint
UNION ALL SELECT query_id, 'unverified marker', 'N3_S3' FROM x WHERE r = 5 AND cited <> 'N3_S3'
UNION ALL SELECT query_id, 'markers shown to a citizen', '' FROM x WHERE r = 6
UNION ALL SELECT query_id, 'citations without content', '' FROM x WHERE r = 7
UNION ALL SELECT query_id, 'no disclaimer', '' FROM x WHERE r IN (8, 9)
UNION ALL SELECT query_id, 'empty answer', '' FROM x WHERE r = 9),
odd AS (SELECT query_id, CAST(k % 40 + 3 AS VARCHAR) AS amount, 'day' AS unit FROM x WHERE r = 4 AND told <> 0)
"""


@query(_CHECKED + "SELECT query_id, rule, detail FROM fails")
def invariant_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that answers must keep, broken by some: a row for each break."""
    return _seeded(spark, d)["failures"]


@query(_CHECKED + "SELECT query_id, amount, unit FROM odd")
def unsourced_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that an answer says before it lists its sections, but neither the sections nor the query."""
    return _seeded(spark, d)["flagged"]


@query(
    _CHECKED + "SELECT (SELECT count(*) FROM x WHERE query_id NOT IN (SELECT query_id FROM fails)) AS passed, (SELECT count(*) FROM x) AS answers, (SELECT count(*) FROM ids) AS citations, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT section_id FROM sections)) AS hallucinated, "
    "(SELECT count(*) FROM st JOIN acts USING (act_id) WHERE status = 'repealed') AS repealed_cited, (SELECT count(DISTINCT query_id) FROM odd) AS flagged, (SELECT count(*) FROM x WHERE r NOT IN (7, 10)) AS ok"
)
def evaluation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts over the answers and what is wrong with them; none of the counts is zero."""
    x = _seeded(spark, d)
    return evaluation.integrity_metrics(x["answers"], cut(x["failures"]), x["flagged"], x["sections"], view(spark, d, "acts"))


# ---- answers put together

_STATES = (
    "SELECT query_id, concat('As [PRIMARY] says, [', {section}, '(1)], and so on. See also [N1_S9999999] .') AS draft_answer, CASE WHEN query_id % 2 = 0 THEN 'Judge' ELSE 'user' END AS persona, CASE WHEN query_id % 50 = 1 THEN 'lost' END AS error, CASE WHEN query_id % 50 = 2 THEN 'evasion' ELSE ' None. ' END AS safety_flag, "
    "query_id % 50 <> 3 AS in_domain, CASE WHEN query_id % 5 = 0 THEN 'insufficient_evidence' ELSE 'ok' END AS guardrail_status, CAST(query_id % 10 AS DOUBLE) / 10 AS confidence, query_id % 4 <> 0 AS sufficient, CASE WHEN query_id % 10 = 0 THEN 'the rest' END AS missing FROM {queries}"
)
_MINE = "concat('N', query_id % 25, '_S', query_id)"
_SUMS = "SELECT query_id, CAST(1 AS INT) AS ord, 'Notice pay' AS label, CAST(query_id % 900 AS DOUBLE) AS amount, '' AS note FROM {0} WHERE query_id % 3 = 0 UNION ALL SELECT query_id, 2, 'Compensation', CAST(NULL AS DOUBLE), 'no daily rate' FROM {0} WHERE query_id % 6 = 0"
_ANSWER = f"""+ st AS ({_STATES.format(section=_MINE, queries='queries')}), v AS (SELECT q.query_id, s.section_id AS id, concat('Section ', s.section_number, ' of the ', a.act_name) AS name FROM queries q JOIN sections s ON s.section_id = {_MINE.replace('query_id', 'q.query_id')} JOIN acts a USING (act_id)),
sums AS ({_SUMS.format('queries')}), am AS (SELECT query_id, string_agg(CASE WHEN amount IS NULL THEN concat(label, ' — not calculated: ', note) ELSE concat(label, ': ₹', amount::BIGINT) END, chr(10) || chr(10) ORDER BY ord) AS amounts FROM sums GROUP BY query_id),
cf AS (SELECT query_id, string_agg(concat(act_name, ' (in force from ', since, ').', CASE WHEN predecessor <> '' THEN concat(' ', predecessor, ' came before it.') ELSE '' END), ' ' ORDER BY act_id) AS conflicts FROM ({raw_sql('commencement_conflicts')}) GROUP BY query_id),
cn AS (SELECT query_id, string_agg(concat(act_name, ' — ', since), '; ' ORDER BY n) AS since FROM ({raw_sql('commencement_notes')}) GROUP BY query_id),
sn AS (SELECT query_id, string_agg(repeal_note, ' ' ORDER BY act_id) AS repealed, string_agg(replacement_note, ' ' ORDER BY act_id) AS replaced FROM ({{superseded}}) GROUP BY query_id),
r AS (SELECT st.*, persona = 'Judge' AS law, CASE WHEN error IS NOT NULL THEN 'error' WHEN safety_flag = 'evasion' THEN 'rejected' WHEN NOT in_domain THEN 'out_of_domain' ELSE guardrail_status END AS status, id, name, amounts, conflicts, since, repealed, replaced
  FROM st LEFT JOIN v USING (query_id) LEFT JOIN am USING (query_id) LEFT JOIN cf USING (query_id) LEFT JOIN cn USING (query_id) LEFT JOIN sn USING (query_id)),
t AS (SELECT *, status = 'insufficient_evidence' AS part FROM r)
SELECT query_id, status, CASE status WHEN 'error' THEN concat('Processing failed.', chr(10), chr(10), 'Cause: lost') WHEN 'rejected' THEN 'No answer is given to this request.' WHEN 'out_of_domain' THEN concat('The question is about something else than the laws held here.', chr(10), chr(10), 'scope') ELSE concat_ws(chr(10),
  CASE WHEN conflicts IS NOT NULL THEN concat(CASE WHEN law THEN 'Date check: the event is dated before commencement. ' ELSE 'Please note first that the law came later than what you describe. ' END, conflicts, chr(10)) END,
  CASE WHEN part THEN concat(CASE WHEN law THEN 'Evidence incomplete: some of the query has no section behind it.' ELSE 'Some of your question is left open by the sections found.' END, CASE WHEN missing IS NOT NULL THEN concat(' Not covered: ', missing, '.') ELSE '' END, chr(10)) END,
  concat('As [PRIMARY] says,', CASE WHEN law AND id IS NOT NULL THEN concat(' [', id, '(1)],') ELSE '' END, ' and so on. See also.'),
  CASE WHEN amounts IS NOT NULL THEN concat(CASE WHEN law THEN concat(chr(10), 'Amounts by rule:', chr(10)) ELSE concat(chr(10), 'What the rules come to:', chr(10)) END, amounts) END,
  concat(chr(10), CASE WHEN law THEN concat('Sections checked: ', coalesce(id, 'none')) WHEN id IS NOT NULL THEN concat('This rests on: ', name) ELSE 'None of the cited sections passed the checks.' END),
  CASE WHEN since IS NOT NULL THEN concat(CASE WHEN law THEN 'Commencement: ' ELSE 'These laws began on: ' END, since, '.') END,
  CASE WHEN replaced IS NOT NULL THEN CASE WHEN law THEN concat('Left out, repealed: ', repealed) ELSE concat('Older law you may come across: ', replaced) END END,
  CASE WHEN law THEN concat('Score: ', printf('%.2f', confidence)) ELSE concat('Certainty: ', CASE WHEN confidence >= 0.7 AND NOT (part OR NOT sufficient) THEN 'high' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'low' END, '.') END,
  concat(chr(10), '{answers.DISCLAIMER}')) END AS final_answer,
  CASE WHEN status IN ('error', 'rejected', 'out_of_domain') THEN 0 ELSE confidence END AS confidence, CASE WHEN status IN ('error', 'rejected', 'out_of_domain') THEN '' ELSE coalesce(id, '') END AS verified, CASE WHEN law THEN 'lawyer' ELSE 'citizen' END AS persona,
  concat_ws(' | ', CASE WHEN id IS NULL THEN concat('Stripped citation ', {_MINE}, ': no such section.') END, 'Stripped citation N1_S9999999: not in the retrieval set.') AS warnings
FROM t"""


@query(_ANSWER.replace("{superseded}", raw_sql("superseded_notes")))
def answers_assembled(spark: SparkSession, d: str) -> DataFrame:
    """A whole answer for each query: its draft rendered and verified, amounts, dates that don't fit, commencement, and law that was replaced."""
    queries, acts = view(spark, d, "queries"), view(spark, d, "acts")
    states = cut(spark.sql(_STATES.format(section=_MINE, queries="{queries}"), queries=queries.select("query_id")))
    cited = cut(answers.parse_citations(states))
    verified, stripped = answers.verify_citations(cited, queries.select("query_id", F.expr(_MINE).alias("section_id")), view(spark, d, "sections"))
    asked = queries.select("query_id", F.col("concept").alias("concept_id"), F.col("jurisdiction").alias("query_jurisdiction"), "event_date").join(view(spark, d, "applies_to"), "concept_id").join(_nodes(spark, d), "section_id")
    notes = temporal.repeal_notes(acts)
    _, gone = temporal.suppress(asked, notes)
    lines = answers.answer_lines(
        answers.display_names(verified, _nodes(spark, d)), spark.sql(_SUMS.format("{queries}"), queries=queries.select("query_id")), temporal.commencement_conflicts(asked.select("query_id", "act_id", "event_date"), acts),
        temporal.commencement_notes(asked.select("query_id", "act_id"), acts), answers.superseded_notes(gone, acts, notes, queries.select("query_id", F.expr(_MINE).alias("section_id"))),
    )
    made = answers.assemble_answers(states, lines, "scope", stripped)
    return made.select("query_id", "status", "final_answer", "confidence", F.array_join("verified_section_ids", " ").alias("verified"), "persona", F.array_join("warnings", " | ").alias("warnings"))
