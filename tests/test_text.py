"""Golden cases of the text functions, and their quirks."""

import pytest
from pyspark.sql import functions as F

from formulary.functions import latex
from formulary.functions import text as T
from formulary.operators import extract


def each(spark, f, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.normalize_latex, {"a−b": "a-b", " a  \n b ": "a b", "3\\,000": "3000", "2×3": "2\\times3", None: ""}),
        (T.relation_class, {"f := 3": "DEF_EQ", "a \\le b": "INEQ", "\\left( x \\right) = 5": "INEQ", "a -> 5": "INEQ", "x = 5": "EQ_NUM", "x = 5 m": "EQ_EXPR", "x = 10^{3}": "EQ_NUM", "x = 2 \\times 10^{3}": "EQ_EXPR", "x = 1e5": "EQ_EXPR", "$x = 5$": "EQ_EXPR", "\\alpha": "OTHER", "a == 5": "EQ_EXPR", "a != 5": "EQ_NUM", "x = -\\,5": "EQ_NUM", None: "OTHER"}),
        (T.rhs_value, {"5": 5.0, "-0.5": -0.5, ".5": 0.5, "10^{ 3 }": 1000.0, "10^{-3}": 0.001, "y": None, "1e5": None, "10^{999}": None, None: None}),
        (T.operator_class, {"\\int f(x) dx = 0": "integral", "\\int_{0}^{1} x": "equation", "\\sum\\limits_{i} x": "summation", "\\sum_{i=1}^{9} x_i = Y": "equation", "\\partial f": "derivative_limit", "\\int \\sum x": "mixed", "\\mathrm{d} x": "derivative_limit", "ab": None, "abc": "equation", "\\integral x": "equation", None: None}),
        (T.clean_line, {"a  b\tc": "a b c", "π = 3": "= 3", "a π b": "a   b", "5−3": "5−3"}),
        (T.latin_line, {"2,5": "2.5", "1,2,3": "1.2,3", "Сх": "Cx", "C(5,2) = 10": "C(5.2) = 10"}),
        (T.is_formula_line, {"2 + 2 = 4": True, "a = b": False, "ИМЕЕМ 2 + 2 = 4": False, "x" * 81 + " + 1 = 2": False, "1 + 1 = ∞": True, None: False, "": False}),
        (lambda c: T.math_text(c)["is_math"], {"": False, "(1)": False, "3.14": False, "x = 5": True, "maximum": True, "a+b": False, "a+b-cd": True, "ab=cd": False, "eliminate it": True, None: False}),
        (T.page_type, {"401": "text", "400": "mixed", "51": "mixed", "50": "scanned"}),
        (extract.inline_formulas, {"5! = 120": ["5! = 120"], "x=5": [], "3/4 = 0.75": ["3/4 = 0.75"], "x^2 = 4": ["x^2 = 4"], "x = 216/990 = 12/55": ["216/990 = 12/55", "216/990 = 12", "x = 216/990"], "C(5, 2) = 10": ["C(5, 2) = 10"], "C(5.2) = 10": []}),
        (latex.to_latex, {"x^2": "x^{2}", "x^10": "x^{1}0", "√(x)": "\\\\sqrt{x}", "tg(x)": "\\\\tan(x)", "C_5^2": "\\binom{5}{2}", "lim(x->inf)": "\\lim_{x \\to \\infty}", "sum(i=1..10)": "\\sum_{i=1}^{10}", "3/4": "\\frac{3}{4}", "πr": "\\pir"}),
        (T.file_name, {"http://a/b c.pdf?x=1": "b_c.pdf", "http://a/b": "b.pdf", None: ".pdf"}),
        (T.is_math_latex, {"abc": False, "a1": True, "\\frac x": True, "": False, None: False}),
    ],
)
def test_golden(spark, f, cases):
    fixed = (lambda c: f(c.cast("int"))) if f is T.page_type else f
    assert each(spark, fixed, list(cases)) == list(cases.values())


def test_display_dollars_also_give_an_inline_hit(spark):
    df = spark.createDataFrame([("$$x$$", 1), (None, 2)], "text string, ord int")
    assert [(r.pattern, r.latex_raw) for r in extract.text_layer_latex(df).collect()] == [("display_dollars", "$$x$$"), ("inline_dollar", "$$x$")]
