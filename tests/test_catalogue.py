"""Every catalogue query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from tessera.plans import answers, evaluation, records, searches, sections  # noqa: F401
from tessera.plans.catalogue import ORACLE_SQL, QUERIES
from tessera.sources.store import table
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, names):
    by = sorted(range(len(names)), key=lambda k: names[k])

    def value(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return "null" if x is None else str(x)

    return sorted(tuple(value(r[k]) for k in by) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.collect()]
    number = lambda rows: [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows]
    assert canonical(number(got), df.columns) == canonical(number(want.fetchall()), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pages_read_lists_that_were_searched_once(spark):
    """What pages are cut from stands in the shared store; neither texts, vectors nor the index are read again for it."""
    of = lambda name: table(spark, SF, name)
    for df in (QUERIES["page_slice"](spark, SF), searches.paged_rows(of)):
        files = df.inputFiles()
        assert files and all("/fused-" in f for f in files)


@pytest.mark.parametrize("name", ["metric_table", "lexical_lead"])
def test_keyword_lists_are_searched_for_once(spark, name):
    """A plan that reads the keyword lists several times reads their few rows, not the index behind them."""
    files = QUERIES[name](spark, SF).inputFiles()
    assert any("/bm25-" in f for f in files) and not any("/indexes/" in f for f in files)
