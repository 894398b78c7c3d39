"""Catalog joins and the classifiers built on them (JO1–JO5, CL1–CL3, FI6–FI7).

The live dataset host is replaced by tables:

* `catalog(path, revision, http_status, detail, disabled, gated, siblings
  ARRAY<STRING>)` — one record per dataset and revision (null: unpinned; a
  missing record answers 404, no status means that the host was not reached);
* `catalog_splits(path, config, split)` — the split list, absent = unknown;
* `loads(path, config, split, revision, status, error_type, error_msg)` —
  how a streaming load of these rows ended: `ok`, `timeout` or `error`;
* `tasks(task)` — the evaluation-task registry; `None` = not installed.

All of these are small per-dataset tables; they are joined to sources with
plain equi-joins and Catalyst/AQE choose broadcast when their measured size
allows. Nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.text import message, quoted, truncate_chars, truthy, ustrip

NUL = "\u0000"  # stands for "absent" inside join keys
FINDING = "struct<ord:int,level:string,message:string>"


def _f(ord_: int, level: str, msg: Column, cond: Column) -> Column:
    return F.when(cond, F.struct(F.lit(ord_).alias("ord"), F.lit(level).alias("level"), msg.alias("message")))


def data_files(siblings: Column) -> Column:
    """FI6: sibling files that are data (suffix test ignores case)."""
    return F.filter(siblings, lambda f: ~F.exists(F.array(*[F.lit(s) for s in K.NON_DATA_SUFFIXES]),
                                                  lambda s: F.lower(f).endswith(s)))


def unshardable_warning(path: Column, siblings: Column) -> Column:
    """FI7: data published as at most two files none of which is
    parquet/arrow: every reader pulls the whole file."""
    data = data_files(F.coalesce(siblings, F.array().cast("array<string>")))
    shardable = F.exists(data, lambda f: F.lower(f).endswith(K.SHARDABLE_SUFFIXES[0])
                         | F.lower(f).endswith(K.SHARDABLE_SUFFIXES[1]))
    cond = (F.size(data) > 0) & ~shardable & (F.size(data) <= 2)
    msg = message(K.MSG_ONE_FILE, path=path, n=F.size(data), files=F.array_join(F.slice(data, 1, 2), ", "))
    return F.when(cond, msg)


def hub_entry(path: Column, revision: Column, training: bool, found: Column, http_status: Column,
              disabled: Column, gated: Column, siblings: Column, detail: Column) -> tuple[Column, Column]:
    """CL1: (findings array, proceed). Missing / 401 / 404 → error naming the
    revision when pinned; other status → error; no status, the host could not
    be reached → error with its `detail`; disabled → error; then the
    layout warning (training only); gated → warning — a gated training
    source stops, a gated benchmark goes on."""
    missing = ~found | F.coalesce(http_status.isin(401, 404), F.lit(False))
    what = F.when(truthy(revision), F.concat(F.lit("revision "), revision, F.lit(" of "), path)).otherwise(path)
    other = found & ~missing & F.coalesce(http_status != 200, F.lit(False))
    silent = found & http_status.isNull()
    stop = missing | other | silent | F.coalesce(disabled, F.lit(False))
    is_gated = truthy(gated)
    findings = [
        _f(1, "error", message(K.MSG_NOT_ON_HUB, what=what), missing),
        _f(1, "error", message(K.MSG_HUB_STATUS, code=http_status, path=path), ~missing & other),
        _f(1, "error", message(K.MSG_UNREACHABLE, detail=F.coalesce(detail, F.lit(""))), silent),
        _f(1, "error", message(K.MSG_DISABLED, path=path), ~missing & ~other & ~silent & F.coalesce(disabled, F.lit(False))),
    ]
    if training:
        layout = unshardable_warning(path, siblings)
        findings.append(_f(2, "warning", layout, ~stop & layout.isNotNull()))
        findings.append(_f(3, "warning", message(K.MSG_GATED_SOURCE, path=path, gated=gated), ~stop & is_gated))
        proceed = ~stop & ~is_gated
    else:
        findings.append(_f(3, "warning", message(K.MSG_GATED_BENCH, path=path, gated=gated), ~stop & is_gated))
        proceed = ~stop
    return F.filter(F.array(*findings), lambda x: x.isNotNull()), proceed


def split_lists(catalog_splits: DataFrame) -> DataFrame:
    """SC4 / JO3: per path, the known (config, split) pairs and their sorted
    display text `name='c' split='s'` (distinct)."""
    return catalog_splits.groupBy("path").agg(
        F.collect_set(F.struct(F.col("config"), F.col("split"))).alias("known_pairs"),
        F.array_sort(F.collect_set(F.concat(F.lit("name="), quoted(F.col("config")), F.lit(" split="),
                                            quoted(F.col("split"))))).alias("known_text"))


def load_error_text(path: Column, name: Column, split: Column, error_type: Column, error_msg: Column,
                    known_pairs: Column, known_text: Column) -> Column:
    """CL2: `<Type>: <msg>` cut at 300 characters; when the split list is
    known and lacks `(config or 'default', split)`, append up to 12 listed
    pairs; else a loading-script message if the error says so."""
    raw = ustrip(F.concat(error_type, F.lit(": "), F.coalesce(error_msg, F.lit(""))))
    msg = truncate_chars(raw, K.LOAD_MSG_MAX_CHARS)
    cfg = F.coalesce(F.nullif(name, F.lit("")), F.lit("default"))
    known = F.coalesce(F.size(known_pairs) > 0, F.lit(False))
    listed = F.exists(known_pairs, lambda p: (p["config"] == cfg) & (p["split"] == split))
    pairs = F.array_join(F.slice(known_text, 1, K.HUB_LIST_MAX_PAIRS), ", ")
    return (F.when(known & ~listed, message(K.MSG_HUB_LISTS, msg=msg, pairs=pairs))
            .when(F.coalesce(error_msg, F.lit("")).contains(K.LOADING_SCRIPT_MARK),
                  message(K.MSG_LOADING_SCRIPT, path=path))
            .otherwise(msg))


def timeout_text(path: Column, rows: int, seconds: float) -> Column:
    """CL3: the deadline message of a load that did not finish."""
    return F.concat(F.lit(f"streaming {rows} rows of "), path, F.lit(f" took longer than {seconds:.0f}s"))


def _same(left: Column, right: Column) -> Column:
    """Equality of optional text where absent ('' or null) equals absent, as a plain equi-join key."""
    return F.coalesce(F.nullif(left, F.lit("")), F.lit(NUL)) == F.coalesce(F.nullif(right, F.lit("")), F.lit(NUL))


def with_catalog(df: DataFrame, path_col: str, catalog: DataFrame, revision: Column | None = None,
                 prefix: str = "c_") -> DataFrame:
    """JO1 / JO2: left join on (path, revision); `found` marks a hit. Without a
    `revision` (benchmarks) the record at no revision is meant. `catalog` may
    leave out `revision` and `detail`: no record is pinned, none unreachable."""
    none = F.lit(None).cast("string")
    optional = {c: F.col(c) if c in catalog.columns else none for c in ("revision", "detail")}
    cat = catalog.select(*[c.alias(f"{prefix}{n}") for n, c in optional.items()], F.lit(True).alias(f"{prefix}found"),
                         *[F.col(c).alias(f"{prefix}{c}") for c in ("path", "http_status", "disabled", "gated", "siblings")])
    at = none if revision is None or "revision" not in catalog.columns else revision
    out = df.withColumn("__at", at).join(
        cat, (F.col(path_col) == F.col(f"{prefix}path")) & _same(F.col("__at"), F.col(f"{prefix}revision")), "left")
    out = out.drop("__at", f"{prefix}path", f"{prefix}revision")
    return out.withColumn(f"{prefix}found", F.coalesce(F.col(f"{prefix}found"), F.lit(False)))


def with_loads(df: DataFrame, path_col: str, loads: DataFrame, splits: DataFrame | None, name: Column, split: Column,
               revision: Column | None = None, prefix: str = "l_"):
    """Join the load outcome of each (path, config, split, revision) and the
    split list of each dataset. `loads` may leave out `config`, `split` or
    `revision`: its outcomes then hold for all of them."""
    none = F.lit(None).cast("string")
    asked = {"config": F.coalesce(F.nullif(name, F.lit("")), F.lit("default")), "split": split,
             "revision": none if revision is None else revision}
    keys = [k for k in asked if k in loads.columns]
    ld = loads.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("path", "status", "error_type", "error_msg", *keys)])
    out = df.withColumns({f"__{k}": asked[k] for k in keys}) if keys else df
    cond = F.col(path_col) == F.col(f"{prefix}path")
    for k in keys:
        cond &= _same(F.col(f"__{k}"), F.col(f"{prefix}{k}"))
    out = out.join(ld, cond, "left").drop(f"{prefix}path", *[x for k in keys for x in (f"__{k}", f"{prefix}{k}")])
    if splits is not None:
        sl = split_lists(splits).select(F.col("path").alias(f"{prefix}spath"), "known_pairs", "known_text")
        out = out.join(sl, out[path_col] == sl[f"{prefix}spath"], "left").drop(f"{prefix}spath")
    else:
        out = out.withColumn("known_pairs", F.lit(None).cast("array<struct<config:string,split:string>>")) \
                 .withColumn("known_text", F.lit(None).cast("array<string>"))
    return out
