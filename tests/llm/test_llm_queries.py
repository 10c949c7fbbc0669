"""Every registered query of the subpackage runs; those with SQL give its rows; no other part of the library needs it."""

import pathlib
import re

import pytest

from tesserine.llm import queries
from tests.oracle import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = rows_of(queries.QUERIES[name](spark, sf))
    assert got[0]
    if name in queries.SQL:
        assert got == rows_of_sql(duck, queries.SQL[name])


def test_columns(spark, sf):
    columns = {
        "p1_found": ["project_id", "path"], "p2_found": ["chunk_a", "chunk_b"], "p3_found": ["chunk_rowid_a", "chunk_rowid_b"], "p4_found": ["chunk_rowid", "line_no"],
        "p6_found": ["query_id", "chunk_rowid"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, names in columns.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.columns == names and df.count() == df.distinct().count()


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(__file__).parent.parent.parent / "tesserine"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"tesserine\.llm|from \.+llm", f.read_text()), f
