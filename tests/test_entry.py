"""Driver contract and a sample of the DuckDB oracle checks at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAST = ["c2_holdout", "c4_stratified_folds", "h8_metric_table", "t1_model_selection", "f3_naive_bayes",
        "d2_profile_numeric", "d11_profile_kendall", "i2_roc", "i15_lift", "e3_yeo_johnson", "f10_knn", "e14_smote"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "selected" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)

    def n(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 5) if isinstance(v, float) else v
    rows = [tuple(n(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = _canon(E.queries()[name](spark, SF).toPandas())
    want = _canon(con.execute(E.oracle_sql()[name]).fetchdf())
    assert got == want
