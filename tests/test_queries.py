"""Every registered query against its SQL, whole tables, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

#: What SQL can't say, and the tests that hold it against something else.
ELSEWHERE = {
    "text_visible": "an HTML parser: test_search.test_visible_text",
    "idx_stemmed": "the stemmer's rules: test_goldens, by a table of stems",
    "search_phrase_compat": "the merge order of three lists: test_search.test_closest_against_all_choices and test_phrase_score",
}


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def cell(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((repr(tuple(cell(r[c]) for c in columns)) for r in df.collect()))
    if name not in ORACLES:
        assert name in ELSEWHERE or name[0] == "p" and name[1].isdigit(), f"{name} has neither SQL nor a test of its own"  # the corpus problems have theirs beside them
        assert columns
        return
    got = sql.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(cell(r[i]) for i in order)) for r in got.fetchall())
    assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
