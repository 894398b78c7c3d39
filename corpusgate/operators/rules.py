"""Manifest rules (MV3–MV29) as Column expressions over the nested manifest.

Each rule yields an optional error struct `(sec, item, sub, loc, msg)`;
`(sec, item, sub)` reproduces the order in which the validation library
reports errors (field order, then list index, then field within an item).
Gating follows the library: a struct's "after" rule runs only when nothing
inside it failed, so the levels are

    L0 field rules → L1 per source / benchmark → L2 data → L3 proposal → L4 file

All of it is per-row work on one nested row: no shuffle, no driver loop.
"""
from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.render import template_columns, template_is_valid
from corpusgate.functions.text import fmt_g, message, quoted, truthy, ustrip

ERROR_TYPE = "struct<sec:int,item:int,sub:int,loc:string,msg:string>"


def no_errors() -> Column:
    return F.array().cast(f"array<{ERROR_TYPE}>")

SEC = {"name": 1, "title": 2, "proposer": 3, "description": 4, "data": 5, "benchmarks": 6,
       "hypothesis": 7, "evidence": 8, "suggested_training": 9, "contamination": 10, "top": 11, "file": 12}


class Candidate(NamedTuple):
    """An error struct and when it applies."""
    cond: Column
    error: Column


def err(cond: Column, sec: int, item, sub: int, loc, msg) -> Candidate:
    item = item if isinstance(item, Column) else F.lit(item)
    loc = loc if isinstance(loc, Column) else F.lit(loc)
    msg = msg if isinstance(msg, Column) else F.lit(msg)
    return Candidate(cond, F.struct(F.lit(sec).alias("sec"), item.cast("int").alias("item"), F.lit(sub).alias("sub"),
                                    loc.alias("loc"), msg.alias("msg")))


def errors(*candidates: Candidate) -> Column:
    """The candidates that apply. Whether any does is asked first: most rows have no error, and that question builds
    nothing."""
    found = F.array(candidates[0].error) if len(candidates) == 1 else F.filter(
        F.array(*[F.when(c.cond, c.error) for c in candidates]), lambda e: e.isNotNull())
    return F.when(reduce(Column.__or__, [c.cond for c in candidates]), found).otherwise(no_errors())


def value_error(msg: Column) -> Column:
    return F.concat(F.lit(K.VALUE_ERROR), msg)


def py_repr_or_none(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("None")).otherwise(quoted(c))


# --- L0 / L1: one source ------------------------------------------------------

def hub_path_error(path: Column) -> Column:
    return value_error(message(K.MSG_HUB_PATH, value=path))


def template_error_detail(t: Column, cols: Column | None = None) -> Column:
    """The text of the exception `str.format` raises for an invalid template
    (first offending token from the left)."""
    tokens = F.regexp_extract_all(t, F.lit(r"\{\{|\}\}|\{[^{}]*\}|\{|\}|[^{}]+"), 0)
    cols = template_columns(t) if cols is None else cols
    n = F.size(tokens)

    def detail(tok: Column, i: Column) -> Column:
        inner = tok.substr(F.lit(2), F.length(tok) - 2)
        name = F.regexp_extract(inner, r"^([^!:.\[]*)", 1)
        is_field = tok.startswith("{") & tok.endswith("}") & (tok != "{{") & (tok != "}}")
        return (F.when(tok == "}", F.lit("Single '}' encountered in format string"))
                .when((tok == "{") & (i == n - 1), F.lit("Single '{' encountered in format string"))
                .when(tok == "{", F.lit("expected '}' before end of string"))
                .when(is_field & (inner == ""), F.lit("Replacement index 0 out of range for positional args tuple"))
                .when(is_field & name.rlike(r"^[0-9]+$"),
                      F.concat(F.lit("Replacement index "), name, F.lit(" out of range for positional args tuple")))
                .when(is_field & ~F.array_contains(cols, name), quoted(name))
                .when(is_field & inner.contains("["), F.lit("string index out of range"))
                .when(is_field & inner.contains("."),
                      F.concat(F.lit("'str' object has no attribute "),
                               quoted(F.regexp_extract(inner, r"\.([^.\[]*)", 1)))))

    found = F.filter(F.transform(tokens, detail), lambda d: d.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit("invalid format string"))


def prepare_sources(sources: Column) -> Column:
    """Each source (`s`) with its template's columns (`tcols`, null without a template)
    and whether the template formats (`tvalid`), computed once per source."""
    with_cols = F.transform(sources, lambda s: F.struct(s.alias("s"), F.when(
        truthy(s["text_template"]), template_columns(s["text_template"])).alias("tcols")))
    return F.transform(with_cols, lambda p: F.struct(p["s"].alias("s"), p["tcols"].alias("tcols"), F.coalesce(F.when(
        p["tcols"].isNotNull(), template_is_valid(p["s"]["text_template"], p["tcols"])), F.lit(True)).alias("tvalid")))


def source_errors(prepared: Column, i: Column) -> Column:
    """Errors of the source at index `i` (0-based, from `prepare_sources`):
    field rules, then — only when they all pass — the rendering rule
    (MV6–MV8)."""
    s, cols = prepared["s"], prepared["tcols"]
    base = F.concat(F.lit("data.dataset_sources."), i.cast("string"))
    path_bad = s["path"].isNull() | ~s["path"].rlike(K.HUB_PATH_PATTERN)
    w = s["weight"]
    weight_low = w <= 0
    weight_high = (w > 1) | F.isnan(w)
    rev_bad = s["revision"].isNotNull() & ~s["revision"].rlike(K.SHA_PATTERN)
    any_field = path_bad | w.isNull() | weight_low | weight_high | rev_bad
    tc, tt = truthy(s["text_column"]), truthy(s["text_template"])
    empty = tt & (F.size(cols) == 0)
    rendering = (
        F.when(tc == tt, message(K.MSG_ONE_RENDERING, path=s["path"]))
        .when(empty, message(K.MSG_NO_PLACEHOLDER, path=s["path"]))
        .otherwise(message(K.MSG_BAD_TEMPLATE, path=s["path"], detail=template_error_detail(s["text_template"], cols)))
    )
    return errors(
        err(s["path"].isNull(), SEC["data"], i, 1, F.concat(base, F.lit(".path")), K.MSG_REQUIRED),
        err(s["path"].isNotNull() & path_bad, SEC["data"], i, 1, F.concat(base, F.lit(".path")),
            hub_path_error(s["path"])),
        err(w.isNull(), SEC["data"], i, 4, F.concat(base, F.lit(".weight")), K.MSG_REQUIRED),
        err(weight_low, SEC["data"], i, 4, F.concat(base, F.lit(".weight")), K.MSG_GT0),
        err(weight_high, SEC["data"], i, 4, F.concat(base, F.lit(".weight")), K.MSG_LE1),
        err(rev_bad, SEC["data"], i, 7, F.concat(base, F.lit(".revision")), value_error(F.lit(K.MSG_REVISION))),
        err(~any_field & ((tc == tt) | empty | (tt & ~prepared["tvalid"])), SEC["data"], i, 9, base,
            value_error(rendering)),
    )


def list_length_error(n: Column, sec: int, loc: str, limit: int) -> Column:
    return err((n < 1) | (n > limit), sec, 0, 0, loc,
               F.when(n < 1, F.lit(K.MSG_LIST_MIN))
               .otherwise(message(K.MSG_LIST_MAX, n=limit, k=n)))


def source_key_repr(s: Column) -> Column:
    return F.concat(F.lit("("), py_repr_or_none(s["path"]), F.lit(", "), py_repr_or_none(s["name"]), F.lit(", "),
                    py_repr_or_none(s["split"]), F.lit(")"))


def same_key(a: Column, b: Column) -> Column:
    return a["path"].eqNullSafe(b["path"]) & a["name"].eqNullSafe(b["name"]) & a["split"].eqNullSafe(b["split"])


def weight_total(sources: Column) -> Column:
    """AG7 in list order, starting from 0, as `sum()` adds."""
    return F.aggregate(sources, F.lit(0.0), lambda acc, s: acc + s["weight"])


def first_repeated_source(sources: Column) -> Column:
    """MV12: the first source whose (path, config, split) was seen before."""
    repeated = F.filter(sources, lambda s, i: F.exists(F.slice(sources, 1, i), lambda x: same_key(x, s)))
    return F.get(repeated, 0)


def data_field_errors(m: Column, n_sources: Column) -> Column:
    """Section `data` below its own rule: list length or per-source errors,
    and the sequence length."""
    sources = m["data"]["dataset_sources"]
    list_ok = (n_sources >= 1) & (n_sources <= K.MAX_SOURCES)
    items = F.when(list_ok, F.flatten(F.transform(prepare_sources(sources), source_errors))).otherwise(no_errors())
    seq = m["data"]["sequence_length"]
    seq_err = err(~seq.isin(*K.SEQUENCE_LENGTHS), SEC["data"], 1000, 0, "data.sequence_length",
                  value_error(F.lit(K.MSG_SEQ_LEN)))
    return F.concat(errors(list_length_error(n_sources, SEC["data"], "data.dataset_sources", K.MAX_SOURCES),
                           seq_err), items)


def data_after_error(total: Column, rep: Column) -> Column:
    """MV11, then MV12 — the `data` rule, given the weight total and the
    first repeated source (both precomputed columns)."""
    after = F.when(F.abs(total - 1.0) > K.WEIGHT_TOLERANCE, value_error(message(K.MSG_WEIGHTS, total=fmt_g(total)))) \
        .when(rep.isNotNull(), value_error(message(K.MSG_TWICE, key=source_key_repr(rep))))
    return errors(err(after.isNotNull(), SEC["data"], 1001, 0, "data", after))


# --- benchmarks -----------------------------------------------------------------

def benchmark_errors_one(b: Column, i: Column) -> Column:
    base = F.concat(F.lit("benchmarks."), i.cast("string"))
    harness_bad = b["harness"].isNull() | ~b["harness"].isin(*K.HARNESSES)
    shots_bad = b["num_fewshot"] < 0
    ds = b["dataset"]
    ds_path_bad = ds["path"].isNull() | ~ds["path"].rlike(K.HUB_PATH_PATTERN)
    any_field = (b["name"].isNull() | harness_bad | F.coalesce(shots_bad, F.lit(False)) | b["metric"].isNull()
                 | b["higher_is_better"].isNull() | ds.isNull() | ds_path_bad | ds["split"].isNull())
    lm = b["harness"] == "lm_eval"
    after = (F.when(lm & ~truthy(b["task"]), message(K.MSG_NEEDS_TASK, name=b["name"]))
             .when(lm & b["num_fewshot"].isNull(), message(K.MSG_NEEDS_SHOTS, name=b["name"]))
             .when(~lm & (truthy(b["task"]) | b["num_fewshot"].isNotNull()), message(K.MSG_EVAL_LOSS, name=b["name"])))
    return errors(
        err(b["name"].isNull(), SEC["benchmarks"], i, 1, F.concat(base, F.lit(".name")), K.MSG_REQUIRED),
        err(b["harness"].isNull(), SEC["benchmarks"], i, 2, F.concat(base, F.lit(".harness")), K.MSG_REQUIRED),
        err(b["harness"].isNotNull() & harness_bad, SEC["benchmarks"], i, 2, F.concat(base, F.lit(".harness")),
            K.MSG_HARNESS),
        err(F.coalesce(shots_bad, F.lit(False)), SEC["benchmarks"], i, 4, F.concat(base, F.lit(".num_fewshot")),
            K.MSG_GE0),
        err(b["metric"].isNull(), SEC["benchmarks"], i, 5, F.concat(base, F.lit(".metric")), K.MSG_REQUIRED),
        err(b["higher_is_better"].isNull(), SEC["benchmarks"], i, 6, F.concat(base, F.lit(".higher_is_better")),
            K.MSG_REQUIRED),
        err(ds.isNull(), SEC["benchmarks"], i, 7, F.concat(base, F.lit(".dataset")), K.MSG_REQUIRED),
        err(ds.isNotNull() & ds["path"].isNull(), SEC["benchmarks"], i, 7, F.concat(base, F.lit(".dataset.path")),
            K.MSG_REQUIRED),
        err(ds["path"].isNotNull() & ds_path_bad, SEC["benchmarks"], i, 7, F.concat(base, F.lit(".dataset.path")),
            hub_path_error(ds["path"])),
        err(ds.isNotNull() & ds["split"].isNull(), SEC["benchmarks"], i, 8, F.concat(base, F.lit(".dataset.split")),
            K.MSG_REQUIRED),
        err(~any_field & after.isNotNull(), SEC["benchmarks"], i, 9, base, value_error(after)),
    )


def benchmark_errors(m: Column, n_benchmarks: Column) -> Column:
    list_ok = (n_benchmarks >= 1) & (n_benchmarks <= K.MAX_BENCHMARKS)
    items = F.when(list_ok, F.flatten(F.transform(m["benchmarks"], benchmark_errors_one))).otherwise(no_errors())
    return F.concat(errors(list_length_error(n_benchmarks, SEC["benchmarks"], "benchmarks", K.MAX_BENCHMARKS)),
                    items)


# --- proposal fields ---------------------------------------------------------------

def _str_len_errors(value: Column, field: str, lo: int | None, hi: int | None, strip: bool) -> list[Column]:
    v = ustrip(value) if strip else value
    out = [err(value.isNull(), SEC[field], 0, 0, field, K.MSG_REQUIRED)]
    if lo is not None:
        out.append(err(F.length(v) < lo, SEC[field], 0, 0, field, K.MSG_STR_MIN.format(n=lo)))
    if hi is not None:
        out.append(err(F.length(v) > hi, SEC[field], 0, 0, field, K.MSG_STR_MAX.format(n=hi)))
    return out


def name_ok(name: Column) -> Column:
    """MV20."""
    return F.when(F.length(name) > K.NAME_MAX_CHARS, F.lit(False)).otherwise(name.rlike(K.NAME_PATTERN))


def name_taken(name: Column) -> Column:
    """MV21 (the list is tiny and fixed, so a literal `isin`)."""
    return name.isin(*K.TAKEN_NAMES)


def field_errors(m: Column) -> Column:
    """Top-level field rules (MV18–MV22) of the proposal."""
    name = m["name"]
    st = m["suggested_training"]
    return errors(
        err(name.isNull(), SEC["name"], 0, 0, "name", K.MSG_REQUIRED),
        err(name.isNotNull() & ~name_ok(name), SEC["name"], 0, 0, "name", value_error(F.lit(K.MSG_NAME))),
        err(name.isNotNull() & name_ok(name) & name_taken(name), SEC["name"], 0, 0, "name",
            value_error(message(K.MSG_TAKEN, name=name))),
        *_str_len_errors(m["title"], "title", K.TITLE_MIN, K.TITLE_MAX, strip=False),
        err(m["proposer"].isNull(), SEC["proposer"], 0, 0, "proposer", K.MSG_REQUIRED),
        err(m["proposer"].isNotNull() & m["proposer"]["github"].isNull(), SEC["proposer"], 0, 1, "proposer.github",
            K.MSG_REQUIRED),
        *_str_len_errors(m["description"], "description", K.STRIPPED_MIN_CHARS["description"], None, strip=True),
        *_str_len_errors(m["hypothesis"], "hypothesis", K.STRIPPED_MIN_CHARS["hypothesis"], None, strip=True),
        *_str_len_errors(m["evidence"], "evidence", K.STRIPPED_MIN_CHARS["evidence"], None, strip=True),
        err(F.coalesce(st["steps"] <= 0, F.lit(False)), SEC["suggested_training"], 0, 1, "suggested_training.steps",
            K.MSG_GT0),
        err(F.coalesce(st["batch_size"] <= 0, F.lit(False)), SEC["suggested_training"], 0, 2,
            "suggested_training.batch_size", K.MSG_GT0),
        *_str_len_errors(m["contamination"], "contamination", K.STRIPPED_MIN_CHARS["contamination"], None, strip=True),
    )


def benchmark_names_repeat(m: Column) -> Column:
    """MV23."""
    names = F.transform(m["benchmarks"], lambda b: b["name"])
    return F.size(F.array_distinct(names)) < F.size(names)


def first_held_out_violation(m: Column) -> Column:
    """MV24 / JO4: the first benchmark scored on a training source's
    (path, config, split), nulls equal."""
    sources = m["data"]["dataset_sources"]
    hits = F.filter(m["benchmarks"], lambda b: F.exists(sources, lambda s: same_key(s, b["dataset"])))
    return F.get(hits, 0)


def held_out_message(b: Column) -> Column:
    return message(K.MSG_HELD_OUT, name=b["name"], path=b["dataset"]["path"], split=b["dataset"]["split"])


def proposal_errors(m: Column, v: Column) -> Column:
    """L3: benchmark names unique, then held-out splits (`v`: the first
    held-out violation, a precomputed column)."""
    msg = F.when(benchmark_names_repeat(m), F.lit(K.MSG_BENCH_UNIQUE)).when(v.isNotNull(), held_out_message(v))
    return errors(err(msg.isNotNull(), SEC["top"], 0, 0, "(top level)", value_error(msg)))


def label(folder: Column, file_stem: Column) -> Column:
    return F.concat(folder, F.lit("/"), file_stem, F.lit(".yaml"))


def file_errors(m: Column, folder: Column, file_stem: Column) -> Column:
    """L4 (MV25, MV26): the file is named after the proposal, in the
    proposer's folder (logins compared ignoring case)."""
    lab = label(folder, file_stem)
    github = m["proposer"]["github"]
    return errors(
        err(m["name"] != file_stem, SEC["file"], 0, 1, F.lit(None).cast("string"),
            message(K.MSG_FILE_NAME, label=lab, name=m["name"])),
        err(F.lower(github) != F.lower(folder), SEC["file"], 0, 2, F.lit(None).cast("string"),
            message(K.MSG_FOLDER, label=lab, github=github, folder=folder)),
    )


def labelled(errs: Column, folder: Column, file_stem: Column) -> Column:
    """MV29: `<folder>/<file>: <loc>: <msg>`; file-level messages carry
    their own label."""
    lab = label(folder, file_stem)
    return F.transform(errs, lambda e: F.when(e["sec"] == SEC["file"], e["msg"])
                       .otherwise(F.concat(lab, F.lit(": "), e["loc"], F.lit(": "), e["msg"])))


def _replaced(errs: Column, extras: Column) -> Column:
    """`errs` without those at, or inside, a place that `extras` reports already."""
    return F.filter(errs, lambda e: ~F.exists(extras, lambda x: (e["loc"] == x["loc"])
                                              | e["loc"].startswith(F.concat(x["loc"], F.lit(".")))))


def _merge_extras(errs: Column, extras: Column, sec: int, n: Column, limit: int) -> Column:
    """Add the decoder's errors of section `sec` (unknown keys, wrong types) to
    its field errors; an item with one loses its "after" rule (sub 9); a list
    over its limit reports nothing but its length."""
    mine = F.filter(extras, lambda x: (x["sec"] == sec) & ((x["item"] < 0) | (x["item"] >= 1000)
                                                           | ((n >= 1) & (n <= limit))))
    kept = F.filter(errs, lambda e: ~((e["sub"] == 9) & F.exists(mine, lambda x: (x["item"] == e["item"])
                                                                  & (x["item"] < 1000))))
    return F.concat(_replaced(kept, mine), mine)


def with_error_columns(df: DataFrame, m: str = "m", n_sources: str = "n_sources",
                       n_benchmarks: str = "n_benchmarks", extra: str | None = None) -> DataFrame:
    """Evaluate every rule of the manifest alone, one stage per column, so that each
    intermediate array is computed once (a value used by two later rules is
    a column, not a repeated sub-expression):

    _e_data_f  data fields and sources      _e_data   + weights / repeats (L2)
    _e_bench   benchmarks                   _e_fields proposal fields
    _e_valid   all library errors, sorted (+ L3 when nothing below failed)
    """
    mc = F.col(m)
    sources = mc["data"]["dataset_sources"]
    df = df.withColumn("_e_data_f", c_data_field_errors(m, n_sources))
    if extra is not None:  # errors found while decoding (MV1, MV2)
        df = df.withColumn("_e_data_f", _merge_extras(F.col("_e_data_f"), F.col(extra), SEC["data"],
                                                        F.col(n_sources), K.MAX_SOURCES))
    fields_ok = F.size("_e_data_f") == 0  # the rules that need all of them
    df = df.withColumn("_total", F.when(fields_ok, weight_total(sources))).withColumn(
        "_rep", F.when(fields_ok, first_repeated_source(sources)))
    df = df.withColumn("_e_data", F.concat(F.col("_e_data_f"), F.when(
        fields_ok, data_after_error(F.col("_total"), F.col("_rep"))).otherwise(no_errors())))
    df = df.withColumn("_e_bench", c_benchmark_errors(m, n_benchmarks)).withColumn("_e_fields", c_field_errors(m))
    if extra is not None:
        df = df.withColumn("_e_bench", _merge_extras(F.col("_e_bench"), F.col(extra), SEC["benchmarks"],
                                                       F.col(n_benchmarks), K.MAX_BENCHMARKS))
        other = F.filter(F.col(extra), lambda x: ~x["sec"].isin(SEC["data"], SEC["benchmarks"]))
        df = df.withColumn("_e_fields", F.concat(_replaced(F.col("_e_fields"), other), other))
    lower = F.concat(F.col("_e_fields"), F.col("_e_data"), F.col("_e_bench"))
    df = df.withColumn("_e_lower", lower)
    df = df.withColumn("_held", F.when(F.size("_e_lower") == 0, first_held_out_violation(mc)))
    return df.withColumn("_e_valid", F.when(F.size("_e_lower") == 0, proposal_errors(mc, F.col("_held"))).otherwise(
        F.sort_array("_e_lower")))


def with_rule_columns(df: DataFrame, m: str = "m", n_sources: str = "n_sources",
                      n_benchmarks: str = "n_benchmarks", folder: str = "folder",
                      file_stem: str = "file_stem", extra: str | None = None) -> DataFrame:
    """`with_error_columns` and

    problems   labelled strings, + file rules (L4) when valid

    `problems` leaves a generator of one row: a filter on it (or on its size, which exploding it adds) would
    otherwise be pushed below all these stages, with every rule written into it several times."""
    df = with_error_columns(df, m, n_sources, n_benchmarks, extra)
    all_errs = F.concat(F.col("_e_valid"), F.when(F.size("_e_valid") == 0, file_errors(
        F.col(m), F.col(folder), F.col(file_stem))).otherwise(no_errors()))
    problems = labelled(all_errs, F.col(folder), F.col(file_stem))
    return df.select("*", F.inline(F.array(F.struct(problems.alias("problems")))))


# --- cached builders over canonical columns -----------------------------------
# `m` is the manifest struct column; `n_sources` / `n_benchmarks` the list
# lengths; `folder` / `file_stem` the file identity.

from corpusgate.functions.cache import session_cached  # noqa: E402


@session_cached
def c_data_field_errors(m: str = "m", n_sources: str = "n_sources") -> Column:
    return data_field_errors(F.col(m), F.col(n_sources))


@session_cached
def c_benchmark_errors(m: str = "m", n_benchmarks: str = "n_benchmarks") -> Column:
    return benchmark_errors(F.col(m), F.col(n_benchmarks))


@session_cached
def c_field_errors(m: str = "m") -> Column:
    return field_errors(F.col(m))


@session_cached
def c_names_repeat(m: str = "m") -> Column:
    return benchmark_names_repeat(F.col(m))


@session_cached
def c_file_errors(m: str = "m", folder: str = "folder", file_stem: str = "file_stem") -> Column:
    return file_errors(F.col(m), F.col(folder), F.col(file_stem))
