"""Every query of the base library against its SQL on the smallest tables, and what the entry point promises."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspark import queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@needs_tables
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows or name == "skip_pattern_hits"
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(queries.SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(got.columns)
        key = lambda r: tuple(map(repr, r))
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted(found.fetchall(), key=key)


@needs_tables
def test_places_are_where_they_say(spark):
    docs = {r.doc_id: r.text.encode() for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    for r in queries.findings_with_ranges(spark, SF).collect():
        assert docs[r.doc_id][r.start_byte : r.end_byte].decode() == r.word


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_nothing_but_the_entry_point_needs_the_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, dirs, names in os.walk(os.path.join(root, "quillspark")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "llm" not in f.read(), n
