import pytest

from conftest import SMALL
from simweave.plans.queries import ORACLE_SQL, QUERIES

#: One query of each stage; the driver's check runs all of them.
STAGES = [
    "q_normalize_lines", "q_clean_documents", "q_chunks", "q_posting_filter", "q_chunk_pairs", "q_text_candidates", "q_text_candidates_deep", "q_simhash",
    "q_jaccard_verify", "q_coverage", "q_pairs_full", "q_groups", "q_run_totals", "q_files_summary", "q_report_totals", "q_image_match",
    "q_group_members", "q_totals_over_threshold", "q_pair_paths", "q_pdf_files", "q_pdf_pages", "q_pdf_images",
]


@pytest.mark.parametrize("name", STAGES)
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["q_document_chunks", "q_document_sketch", "q_document_posting_filter", "q_document_chunk_pairs", "q_document_verify", "q_document_groups"])
def test_stage_on_documents_equals_sql(name, spark, same_as_sql):
    assert "FROM documents" in ORACLE_SQL[name] and "matched_texts" not in ORACLE_SQL[name]
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_windows_of_long_documents(spark):
    # most files of the matched texts have one chunk a page
    pieces = QUERIES["q_document_chunks"](spark, SMALL)
    assert pieces.where("start > 0").count() > 20


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
