"""Text rendering and template rules."""
import pytest
from pyspark.sql import functions as F

from corpusgate.functions.render import (compile_template, render_by_template_column, row_values_map,
                                         template_columns, template_is_valid)
from corpusgate.functions.text import fmt_g, percent, ustrip
from corpusgate.operators.rules import template_error_detail


def one(spark, col, value, ddl="t string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("r")).collect()[0].r


def test_template_columns_in_order(spark):
    assert one(spark, template_columns("t"), "User: {query}\n\nAssistant: {response}") == ["query", "response"]
    assert one(spark, template_columns("t"), "{a} {b.x} {a} {c[0]} {{d}} { e }") == ["a", "b", "c", "e"]


@pytest.mark.parametrize("template,valid", [
    ("{a} {b}", True), ("just words", True), ("{first name}", True), ("{{x}} {a}", True),
    ("{a} {}", False), ("{a} {b", False), ("{0}", False), ("{a:>10}", False), ("{a!r}", False),
    ("{ a }", False), ("{a[0]}", False), ("a}b", False), ("{{{a}}}", False),
])
def test_template_validity(spark, template, valid):
    assert one(spark, template_is_valid("t"), template) is valid


@pytest.mark.parametrize("template,detail", [
    ("{a} {b", "expected '}' before end of string"),
    ("{a} {}", "Replacement index 0 out of range for positional args tuple"),
    ("a}b", "Single '}' encountered in format string"),
    ("a {", "Single '{' encountered in format string"),
    ("{ a }", "' a '"),
])
def test_template_error_detail(spark, template, detail):
    assert one(spark, template_error_detail(F.col("t")), template) == detail


def test_compile_template(spark):
    df = spark.createDataFrame([("q", None, True, 7)], "question string, answer string, flag boolean, n int")
    col = compile_template("Q: {question} A: {answer} {flag} {n} {{x}}", df.schema)
    assert df.select(col.alias("r")).collect()[0].r == "Q: q A: None True 7 {x}"


def test_render_by_template_column(spark):
    df = spark.createDataFrame([("{a}-{b} {{c}}", "1", None), ("{a}{zz}", "1", "2")], "t string, a string, b string")
    vals = row_values_map(df.select("a", "b").schema)
    out = [r.r for r in df.select(render_by_template_column(F.col("t"), vals).alias("r")).collect()]
    assert out == ["1-None {c}", ""]


def test_scalar_helpers(spark):
    assert one(spark, ustrip("t"), "  ...\n ") == "..."
    assert one(spark, percent("x"), 0.125, "x double") == "12%"
    assert one(spark, percent("x"), 0.135, "x double") == "14%"
    assert one(spark, fmt_g("x"), 0.7, "x double") == "0.7"
    assert one(spark, fmt_g("x"), 1.4999999999999998, "x double") == "1.5"
    assert one(spark, fmt_g("x"), 0.9999999999999999, "x double") == "1"
    assert one(spark, fmt_g("x"), 1.2345678, "x double") == "1.23457"
