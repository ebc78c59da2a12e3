import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog as graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["concept_sections_live", "bounded_bfs", "section_neighbors", "suppressed_reasons", "direct_references", "extract_cites", "segment_hard_documents", "verify_citations", "merge_aliases", "citation_evidence", "merged_hits", "expectation_failures", "ground_by_substring", "records_read", "bad_record_lines", "reloaded_graph", "amounts_listed", "invariant_failures", "evaluation_metrics", "answers_assembled", "retrieval_summaries", "ground_phrases"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = graph.queries()[name](spark, SF)
    cursor = con.execute(graph.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in found.collect())
    assert mine == sorted(repr(tuple(r[names.index(c)] for c in order)) for r in cursor.fetchall())
    assert mine
