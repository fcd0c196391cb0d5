from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.scalars import decimal_key, folded
from tidemark.operators.diff import SAME, diff_copies, summarise, within


def compare(spark, main, copy):
    schema = "k string, x double, s string, k0 int, side string"
    return diff_copies(spark.createDataFrame(main, schema), spark.createDataFrame(copy, schema), keys={"k": "k"}, fields={"x": ("x", within(0.00005)), "s": ("s", SAME)}).select("k", "finding")


def test_missing_on_either_side_and_differing_fields(spark):
    main = [("a", 1.0, "p", 0, ""), ("b", 1.0, "p", 0, ""), ("c", None, None, 0, "")]
    copy = [("a", 1.00004, "p", 9, "z"), ("b", 1.001, "q", 9, "z"), ("d", 1.0, "p", 9, "z")]
    assert rows(compare(spark, main, copy)) == [("b", "s"), ("b", "x"), ("c", "missing_in_copy"), ("d", "missing_in_main")]


def test_nulls_nan_repeated_rows_and_null_keys(spark):
    nan = float("nan")
    main = [("a", None, None, 0, None)] * 3 + [("b", nan, "p", 0, None), ("c", nan, "p", 0, None), (None, 1.0, "p", 0, None), ("d", None, "p", None, None)]
    copy = [("a", None, None, 0, None), ("b", nan, "p", 0, None), ("c", 1.0, "p", 0, None), (None, 2.0, "p", 0, None), ("d", 1.0, None, 0, None)]
    assert rows(compare(spark, main, copy)) == [(None, "x"), ("c", "x"), ("d", "s"), ("d", "x")]


def test_empty_sides(spark):
    one = [("a", 1.0, "p", 0, "")]
    assert rows(compare(spark, one, [])) == [("a", "missing_in_copy")]
    assert rows(compare(spark, [], one)) == [("a", "missing_in_main")]
    assert rows(compare(spark, [], [])) == []


def test_summary_counts(spark):
    found = compare(spark, [("a", 1.0, "p", 0, ""), ("b", 1.0, "p", 0, "")], [])
    assert rows(summarise(found, ["finding"])) == [("missing_in_copy", 2)]


def test_decimals_equal_by_number_not_by_spelling(spark):
    same = ["1.50", "+1.5", " 15E-1 ", "0.15e1", "001.5000", "150e-2"]
    zero = ["0", "-0.00", "0E5", ".0"]
    other = ["1.51", "-1.5", "15"]
    df = spark.createDataFrame([(x,) for x in same + zero + other + ["n/a", "", None, "9" * 60, "9" * 60 + ".0"]], "x string").select("x", decimal_key(F.col("x")).alias("k"))
    k = {r["x"]: r["k"] for r in df.collect()}
    assert len({k[x] for x in same}) == 1 and len({k[x] for x in zero}) == 1
    assert len({k[x] for x in [same[0], zero[0], *other, "n/a", ""]}) == 7
    assert k[None] is None and k["9" * 60] == k["9" * 60 + ".0"]


def test_names_fold_case_and_blanks(spark):
    df = spark.createDataFrame([("  Labor\t statistics  TABLE ",), ("labor statistics table",), (None,)], "x string")
    assert [r[0] for r in df.select(folded(F.col("x"))).collect()] == ["labor statistics table", "labor statistics table", None]
