"""Quoting of names, numbers as text, and finding a manifest by name."""
import math
import random
import struct

import pytest

from corpusgate.functions.text import float_text, fmt_g, quoted
from corpusgate.functions.ordered import joined, step
from corpusgate.operators.names import duplicate_names, find_manifests

NAMES = ["plain", "", "it's", 'say "it"', 'it\'s "it"', "back\\slash", "two\nlines", "a\tb\r", "\x00\x1b\x7f", "\x85\xa0\xad", "é 東京",
         "'", "\\'"]


def test_names_are_quoted_as_python_does(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert [tuple(r) for r in df.select("n", quoted("n")).collect()] == [(n, repr(n)) for n in NAMES]


def doubles():
    rng = random.Random(17)
    some = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(6000)]
    some += [rng.uniform(-10, 10) for _ in range(1000)] + [round(rng.uniform(0, 1000), rng.randrange(6)) for _ in range(1000)]
    some += [rng.randrange(1, 1000) * 10.0 ** rng.randrange(-20, 25) for _ in range(1000)]
    some += [s * 10.0 ** e for e in range(-30, 31) for s in (1, -1, 9.999995, 1.0000005, 1.5, 2)]
    return some + [0.0, -0.0, 5e-324, 2e-3, 2e23, 1e16, 1e15, 9999999999999998.0, 123456.5, 999999.5, 0.1 + 0.2, 2.2250738585072014e-308,
                   1.7976931348623157e308, math.inf, -math.inf, math.nan, 5e-5, 0.0001, 0.00001, 1e5, 1e6]


def test_numbers_print_as_in_python(spark):
    df = spark.createDataFrame([(x,) for x in doubles()] + [(None,)], "x double").repartition(8)
    rows = df.select("x", float_text("x").alias("s"), fmt_g("x").alias("g")).collect()
    assert [(r.x, r.s) for r in rows if r.x is not None and r.s != str(r.x)] == []
    assert [(r.x, r.g) for r in rows if r.x in (0.5, 0.25, 1.5, 3.0, 0.999, 1e5)
            and r.g != f"{r.x:g}"] == []
    assert [(r.s, r.g) for r in rows if r.x is None] == [(None, None)]


@pytest.mark.parametrize("name,path", [
    ("exp_a", "examples/zoe/exp_a.yaml"),            # examples come before proposals
    ("exp_b", "proposals/bob/exp_b.yaml"),           # `bob` before `bob-x`, though `-` sorts before `/`
    ("proposals/bob-x/exp_b.yaml", "proposals/bob-x/exp_b.yaml"),
    ("exp_none", None),
])
def test_a_name_finds_the_first_file_in_path_order(spark, name, path):
    files = spark.createDataFrame([("proposals", "amy", "exp_a"), ("examples", "zoe", "exp_a"), ("proposals", "bob-x", "exp_b"),
                                   ("proposals", "bob", "exp_b")], "root string, folder string, file_stem string")
    found = find_manifests(spark.createDataFrame([(name,)], "name string"), files).collect()
    assert [r.path for r in found] == ([path] if path else [])


def test_a_stem_with_very_many_owners_meets_as_a_few_pieces(spark):
    n = 40_000
    files = spark.range(n).selectExpr("concat('u', lpad(id, 6, '0')) as folder", "'exp_hot' as file_stem").unionByName(
        spark.createDataFrame([("b", "exp_x"), ("a", "exp_x"), ("a", "exp_x"), ("c", "exp_one")], "folder string, file_stem string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.key: r.message for r in duplicate_names(files).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {"exp_hot", "exp_x"} and "(a, b)" in got["exp_x"]
    assert ", ".join(f"u{i:06d}" for i in range(n)) in got["exp_hot"]


def test_pieces_keep_the_order_and_bound_what_meets(spark):
    rows = spark.range(25_000).selectExpr("id % 2 as k", "id as seq", "concat('t', id) as t").unionByName(
        spark.createDataFrame([(0, None, "last")], "k long, seq long, t string"))
    got = {r.k: r.out for r in joined(rows, ["k"], step("seq"), ["seq"], "t", "|", "out").collect()}
    assert got == {k: "|".join([f"t{i}" for i in range(k, 25_000, 2)] + ["last"] * (k == 0)) for k in (0, 1)}
    assert rows.groupBy("k", step("seq").alias("b")).count().agg({"count": "max"}).first()[0] <= 500
