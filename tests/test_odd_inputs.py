"""Registered queries against their SQL statements on tables with rows that the supplied ones do not have."""

import os

import duckdb
import pytest

from paperloom.plans import load_all
from paperloom.plans.check import compare, connect

QUERIES = load_all()


def changed(folder, sf, name, statement):
    """A copy of the tables at ``sf``, linked, with one of them made anew by a statement over the old one."""
    for f in os.listdir(sf):
        if f != f"{name}.parquet":
            os.symlink(f"{sf}/{f}", f"{folder}/{f}")
    duckdb.sql(f"COPY ({statement.format(old=f'{sf}/{name}.parquet')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory, sf):
    return changed(
        tmp_path_factory.mktemp("documents"), sf, "documents",
        """SELECT * REPLACE (CASE doc_id % 9 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN chr(10) || text WHEN 4 THEN '{{,}}' || chr(10) || text
        WHEN 5 THEN '«no text»' ELSE text END AS text) FROM '{old}'""",
    )


@pytest.mark.parametrize("name", ["f2_parse_responses", "f4_valid_entities", "f5_valid_relations", "f22_extraction_stats", "f23_vertices", "f23_edges", "f23_properties"])
def test_answers_quote_empty_lines_and_documents_without_text(spark, odd_documents, name):
    ok, message, rows, _ = compare(spark, connect(odd_documents), QUERIES[name], odd_documents)
    assert ok, message
    assert rows > 0
