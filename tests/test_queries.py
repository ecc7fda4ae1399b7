"""Every query with an oracle gives the oracle's rows; functions keep their named cases."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from refloom.functions import identifiers, names, rendering
from refloom.plans import catalogue
from refloom.plans.relations import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in plain.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://doi.org/10.1/ABC.", "10.1/abc"), (" HTTP://dx.doi.org/10.1130/2013.2500(04) ", "10.1130/2013.2500(04)"), ("10.1/x).", "10.1/x"), ("10.1/a[b].,;", "10.1/a[b]"), ("10.1/a]", "10.1/a"), ("", "")],
)
def test_normalise_doi(spark, raw, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(identifiers.normalise_doi(F.lit(raw))).first()[0] == want


def test_named_cases(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(identifiers.extract_dois(F.lit("doi:10.1234/A(1). and https://doi.org/10.1234/a(1"))) == ["10.1234/A(1"]
    assert one(rendering.marker_numbers(F.lit("[3,5-7]"))) == [3, 5, 6, 7] and one(rendering.marker_numbers(F.lit("[9-2]"))) == [9, 2] and one(rendering.marker_numbers(F.lit("[1-500]"))) == [1, 500]
    assert one(names.surname_key(F.lit("Østergård-Weiß"))) == "ostergard-weiss" and one(names.compact_surname(F.lit("van der Berg"))) == "vanderberg"
    assert one(names.library_title_key(F.lit(" Café,  AU Lait "))) == "cafe, au lait" and one(names.fuzzy_title_key(F.lit("Café, AU"))) == "caf au"
