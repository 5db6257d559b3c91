"""Every query of the catalogue that SQL can express gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from safelens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents labels conversations events pages lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_pages_cut_inside_a_reference(spark, tmp_path):
    htmls = ["<h1>a &amp; b &amp</h1>&copy; x", "&quot", "&am &quo; &amp&amp;", "&amp;quot; &quot;q&quot;", "R&D & more &middot; &", " ", "", None]
    spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rows = catalogue.queries()["html_decode_pages"](spark, str(tmp_path)).collect()
    want = con.execute(catalogue.oracle_sql()["html_decode_pages"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) == 5
