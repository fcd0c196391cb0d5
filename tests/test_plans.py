import os

import pytest

import __spark_entry__
from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_and_sql_have_the_same_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(registry.QUERIES) > 200


@here
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "series_id", "alfred_id", "observation_date", "value"] and df.count() > 0


@here
def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole schemas in the plan's text
    p = plan(registry.QUERIES["sc01_table_scan"](spark, DATA))
    assert "GreaterThanOrEqual(o_totalprice,450000.0)" in p and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in p
    p = plan(registry.QUERIES["p2_found"](spark, DATA))
    # the facts with the receipt they name, and of the receipts only its time
    assert "ReadSchema: struct<event_id:string,event_type:string,scheduled_at:string,retrieved_at:string,receipt_id:string,actual:double>" in p and "ReadSchema: struct<receipt_id:string,retrieved_at:string>" in p


@here
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.startswith("p") and n[1].isdigit()])
def test_no_products_and_no_nested_loops(spark, name):
    p = plan(registry.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "BatchEvalPython" not in p


@here
def test_hot_aggregations_combine_before_the_shuffle(spark):
    p = plan(registry.QUERIES["p1_found"](spark, DATA))
    assert p.count("partial_max") >= 2


@here
def test_weeks_are_those_of_the_calendar(spark):
    assert registry.QUERIES["sm05_weekly_buckets"](spark, DATA).where("dayofweek(week) != 2").count() == 0


def test_the_rest_works_when_the_subpackage_cannot_be_imported():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    blocked = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; print('NAMES', len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", blocked], cwd=root, capture_output=True, text=True, timeout=120)
    assert "NAMES" in done.stdout and int(done.stdout.split("NAMES")[1]) == len(registry.QUERIES), done.stderr[-500:]


def test_import_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert "NAMES" in done.stdout, done.stderr[-500:]
