import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tabuloom.functions import pvalues as pv
from tabuloom.functions import text as x
from tabuloom.functions.scales import bottom2box, nps_group, top2box


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(df, expression):
    return [r["r"] for r in df.select("i", expression.alias("r")).orderBy("i").collect()]


def test_normalize_text(spark):
    df = column(spark, ["  Sí, ÁÉÍ-ñ  ", "ﬁn ½", "a__b--c", None, "***", "Été"])
    assert run(df, x.normalize_text(F.col("v"))) == ["si_aei_n", "fin_1_2", "a_b_c", "", "", "ete"]
    assert [x.plain_normalize(v) for v in ("  Sí, ÁÉÍ-ñ  ", "a__b--c", None)] == ["si_aei_n", "a_b_c", ""]


def test_code_text_joins_spellings(spark):
    text = column(spark, ["12.0", "12", " 12 ", "1e1", "nan", "1d", None, "x "])
    assert run(text, x.code_text(F.col("v"))) == ["12", "12", "12", "10", "nan", "1d", "", "x"]
    numbers = column(spark, [12.0, 0.5, float("nan"), None, -3.0], "double")
    assert run(numbers, x.code_text(F.col("v"), T.DoubleType())) == ["12", "0.5", "", "", "-3"]


def test_truthy(spark):
    text = column(spark, ["Sí", "x", "no", "1", "1.0", None, "Recomendada"])
    assert run(text, x.truthy(F.col("v"))) == [True, True, False, True, False, False, True]
    numbers = column(spark, [1.0, 2.0, None], "double")
    assert run(numbers, x.truthy(F.col("v"), T.DoubleType())) == [True, False, False]


def test_small_texts(spark):
    df = column(spark, ["  a \n b\tc ", None, "y" * 130])
    assert run(df, x.clean_open_text(F.col("v")))[:2] == ["a b c", ""]
    assert run(df, x.short_text(F.col("v")))[2] == "y" * 119 + "…"
    names = column(spark, ["Q1_2-3", "Q7", "a12b3"])
    assert run(names, x.suffix_code(F.col("v"))) == ["3", "Q7", "a12b3"]
    assert run(names, x.numeric_part(F.col("v"))) == [1.0, 7.0, 12.0]
    blanks = column(spark, [" ", "nan", "z"])
    assert run(blanks, x.first_text(F.col("v"), F.lit("d"))) == ["d", "d", "z"]


def test_boxes_and_nps(spark):
    df = column(spark, [4.5, 4.0, 1.0, 2.0, None], "double")
    one, five, seven = F.lit(1.0), F.lit(5.0), F.lit(7.0)
    assert run(df, top2box(F.col("v"), one, five)) == [0, 1, 0, 0, 0]
    assert run(df, bottom2box(F.col("v"), one, five)) == [0, 0, 1, 1, 0]
    assert run(column(spark, [6.0, 5.9, None], "double"), top2box(F.col("v"), one, seven)) == [1, 0, 0]
    nps = column(spark, [6.0, 6.5, 7.0, 9.0, 11.0, -1.0], "double")
    assert run(nps, nps_group(F.col("v"))) == ["Detractor", "", "Pasivo", "Promotor", "", ""]


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 0.1, 0.5, 0.66, 1.0, 1.96, 3.0, 5.0, 6.5, 10.0, -2.0, 37.0]
    got = run(column(spark, zs, "double"), pv.normal_two_sided(F.col("v")))
    for z, p in zip(zs, got):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-13, abs=1e-300)


def test_student_tail_closed_forms():
    t = np.array([0.3, 1.0, 4.0])
    one = pv.student_tail_array(t, np.ones(3))
    assert one == pytest.approx([1 - 2 * math.atan(v) / math.pi for v in t], rel=1e-12)
    two = pv.student_tail_array(t, np.full(3, 2.0))
    assert two == pytest.approx([1 - v / math.sqrt(2 + v * v) for v in t], rel=1e-12)
    large = pv.student_tail_array(np.array([1.96]), np.array([1e7]))
    assert large == pytest.approx([math.erfc(1.96 / math.sqrt(2))], rel=1e-6)
    q = pv.student_quantile_array(np.array([0.975]), np.array([10.0]))
    assert q == pytest.approx([2.2281388519649385], rel=1e-10)


def test_binomial_is_exact():
    for b, n in [(0, 5), (3, 10), (5, 10), (12, 40), (700, 1500)]:
        k = min(b, n - b)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)
        assert pv.binomial_half_array(np.array([b]), np.array([n]))[0] == pytest.approx(exact, rel=1e-9)
    assert pv.binomial_half_array(np.array([0]), np.array([0]))[0] == 1.0
