"""Can the data run? Source and benchmark verdicts, and the proposal report
(CL4–CL6, JO5, JO7, FI3–FI5, AG6, AG8, AG11, AG12).

The corpus work is done once per *rendering* — a distinct (corpus, text column,
template) — however many manifests, paths and sequence lengths name it. Sources
and benchmarks of one check share one pass over the corpus rows (`profile`):
rows are joined to the renderings that read them and collapse into (rendering,
length, prefix key, n); row counts, non-text counts, medians, duplicates and the
shares over any window all come from that table. Cheap checks come first: only
what the catalog lets proceed and what loaded becomes a request, and the store
opens only the partitions that some request names.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgate import constants as K
from corpusgate.functions.cache import session_cached
from corpusgate.functions.joins import null_safe_join, sized
from corpusgate.functions.render import (benchmark_subject, columns_used, render_by_template_column, row_values_map,
                                         template_columns)
from corpusgate.functions.text import message, percent, quoted, truthy
from corpusgate.operators.rules import py_repr_or_none
from corpusgate.operators import catalog as C
from corpusgate.operators import profile as P

SALT_ABOVE = 10_000  # renderings: below, the table of renderings goes to the rows and no key can be hot


@dataclass
class Corpora:
    """The rows of all corpora and how a request names them.

    rows:    the store; its columns `keys` say to which corpus a row belongs
    key_of:  (path, name, split, revision) -> {key: Column}, a null key naming no rows
    schema:  the data columns, which FI3 lists and renderings read
    order:   the ordinal that "first n rows" goes by
    visible: (last key, added): which values of the last key a request for one sees, where rows are kept
             under the revision that added them; None: only its own
    """
    rows: DataFrame
    keys: list[str]
    key_of: Callable[..., dict[str, Column]]
    schema: T.StructType
    order: str
    sample_rows: int | None = None
    visible: DataFrame | None = None
    columns: list[str] = field(init=False)

    def __post_init__(self):
        self.columns = sorted(f.name for f in self.schema.fields)

    def named(self, df: DataFrame, path: str, name: str, split: str, revision: Column) -> DataFrame:
        return df.withColumns({f"k_{k}": v for k, v in self.key_of(F.col(path), F.col(name), F.col(split), revision).items()})

    @property
    def asked(self) -> list[str]:
        return [f"k_{k}" for k in self.keys]


def salted(rows: DataFrame, wanted: DataFrame, keys: list[str], order: str, most: int = SALT_ABOVE) -> DataFrame:
    """JO7: `rows` joined to `wanted` on `keys` (`k_...` there).

    Few wanted rows are sent to the rows. Of many, those of a hot corpus (more rows than an even share of a
    partition) are replicated per salt, and its rows dealt over the salts: as many as it has even shares.
    At most as many corpora as there are partitions can be hot, so their list is small."""
    on = [F.col(k) == F.col(f"k_{k}") for k in keys]
    if wanted.count() <= most:
        return rows.join(wanted, on)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    hot = [r for r in sizes.filter(F.col("size") * n > total).collect()]
    salts = rows.sparkSession.createDataFrame(
        [(*[r[k] for k in keys], -(-r["size"] * n // max(1, total))) for r in hot],
        T.StructType([*[T.StructField(f"h_{k}", rows.schema[k].dataType) for k in keys], T.StructField("salts", T.LongType())]))
    salts = F.broadcast(salts)
    is_hot = lambda prefix: [F.col(f"{prefix}{k}") == F.col(f"h_{k}") for k in keys]
    drop = [f"h_{k}" for k in keys]
    left = (rows.join(salts, is_hot(""), "left").drop(*drop)
            .withColumn("salt", F.pmod(F.xxhash64(order), F.coalesce("salts", F.lit(1)))).drop("salts"))
    right = (wanted.join(salts, is_hot("k_"), "left").drop(*drop)
             .withColumn("w_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts"))
    return left.join(right, [*on, F.col("salt") == F.col("w_salt")]).drop("salt", "w_salt")


def profile(requests: DataFrame, corpora: Corpora) -> DataFrame:
    """JO7 + AG6 for every request (k_..., text_column, text_template, seq_len), distinct.

    Returns the requests with rows (null: none), non_text, median_chars and the short, dup and long shares.
    A request without column and template asks for the row count alone. The renderings are written before, so
    their bytes decide how they are joined; the scan reads only the columns that some rendering uses (their
    number is bounded by the schema)."""
    keys = corpora.keys
    what = [*corpora.asked, "text_column", "text_template"]
    req = requests.select(*what, "seq_len").distinct()
    renderings = sized(req.select(*what).distinct().withColumn("rid", F.monotonically_increasing_id()), "renderings")
    used = {r[0] for r in renderings.select(F.explode(columns_used(F.col("text_column"), F.col("text_template"))))
            .distinct().filter(F.col("col").isin(corpora.columns)).collect()}
    fields = [f for f in corpora.schema.fields if f.name in used]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    values = row_values_map(corpora.schema, sorted(used)) if fields else F.create_map().cast("map<string,string>")
    rows = corpora.rows.select(*keys, F.col(corpora.order).alias("c_ord"), values.alias("values"))
    # a comparison on the requests' side is what lets the scan open only the partitions they name
    wanted = renderings.where((F.col("rid") >= 0) & F.col(corpora.asked[0]).isNotNull())
    if corpora.visible is not None:
        wanted = (wanted.join(corpora.visible, corpora.asked[-1]).drop(corpora.asked[-1])
                  .withColumnRenamed("added", corpora.asked[-1]))
    elif corpora.sample_rows is not None:  # SC2 / WI1: first n rows per corpus, before the fan-out to renderings
        rows = P.first_n(rows, keys, ["c_ord"], corpora.sample_rows)
    joined = salted(rows, wanted, keys, "c_ord")
    if corpora.visible is not None and corpora.sample_rows is not None:
        joined = P.first_n(joined, ["rid"], ["c_ord"], corpora.sample_rows)
    tc = F.col("text_column")
    text = F.when(truthy(tc), F.coalesce(F.col("values")[tc], F.lit(""))) \
        .otherwise(render_by_template_column(F.col("text_template"), F.col("values")))
    is_string = F.array_contains(F.array(*[F.lit(c) for c in strings]), tc) if strings else F.lit(False)
    non_text = truthy(tc) & F.when(is_string, F.col("values")[tc].isNull()).otherwise(F.lit(True))
    windows = null_safe_join(req, renderings, what)
    out = histograms(joined.select("rid", text.alias("text"), F.coalesce(non_text, F.lit(False)).alias("bad")),
                     windows.select("rid", "seq_len"))
    return null_safe_join(windows, out, ["rid", "seq_len"], "left").drop("rid")


def row_counts(requests: DataFrame, corpora: Corpora) -> DataFrame:
    """(k_..., rows) of the corpora that requests name and that have rows, from the key columns alone."""
    keys, asked = corpora.keys, corpora.asked
    wanted = requests.select(*asked).distinct()
    wanted = (wanted.withColumn("w_added", F.col(asked[-1])) if corpora.visible is None
              else wanted.join(corpora.visible.withColumnRenamed("added", "w_added"), asked[-1]))
    sizes = corpora.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    on = [F.col(k) == F.col(a) for k, a in zip(keys, [*asked[:-1], "w_added"])]
    rows = F.sum("size") if corpora.sample_rows is None else F.least(F.sum("size"), F.lit(corpora.sample_rows))
    return sizes.join(wanted, on).groupBy(*asked).agg(rows.alias("rows"))


def histograms(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """AG6 per (rid, seq_len) of `windows` from rendered `texts` (rid, text, bad).

    The only exchange that carries row-level volume holds (rid, length, prefix key, bad, n). Its result is written,
    so the corpora are read once whatever is asked of it: the counts and the length histogram both aggregate it,
    and the medians and the shares over every window the histogram."""
    length = F.coalesce(F.length("text"), F.lit(0))
    base = sized(texts.select("rid", "bad", length.alias("len"), F.when(P.usable("text"), P.prefix_key("text")).alias("pk"))
                 .groupBy("rid", "bad", "len", "pk").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = base.groupBy("rid").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("non_text"),
        F.sum(F.when(F.col("len") >= K.MIN_TEXT_CHARS, F.col("n")).otherwise(0)).alias("usable"),
        F.count_distinct("pk").alias("prefixes"))
    lengths = base.groupBy("rid", "len").agg(F.sum("n").alias("n"))
    median = lengths.groupBy("rid").agg(
        F.floor(F.percentile("len", F.lit(0.5), F.col("n"))).cast("bigint").alias("median_chars"))
    over = (lengths.join(windows, "rid").groupBy("rid", "seq_len")
            .agg(F.sum(F.when(F.col("len") > F.col("seq_len") * K.CHARS_PER_TOKEN, F.col("n")).otherwise(0)).alias("over")))
    return over.join(counts, "rid").join(median, "rid").select(
        "rid", "seq_len", "rows", "non_text", "median_chars",
        (F.lit(1) - F.col("usable") / F.col("rows")).alias("short_share"),
        F.when(F.col("usable") == 0, F.lit(0.0)).otherwise(F.lit(1) - F.col("prefixes") / F.col("usable")).alias("dup_share"),
        (F.col("over") / F.col("rows")).alias("long_share"))


def missing_columns(text_column: Column, text_template: Column, corpus_columns: list[str]) -> Column:
    """FI3: columns the source reads that the corpus lacks, in use order."""
    used = columns_used(text_column, text_template)
    return F.filter(used, lambda c: ~F.array_contains(F.array(*[F.lit(x) for x in corpus_columns]), c))


def _py_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def _fd(ord_: int, level: Column | str, msg: Column, cond: Column) -> Column:
    level = F.lit(level) if isinstance(level, str) else level
    return F.when(cond, F.struct(F.lit(ord_).alias("ord"), level.alias("level"), msg.alias("message")))


@session_cached
def c_loaded() -> Column:
    """Sources whose rows are looked at: the catalog lets them proceed and the load succeeded."""
    _, proceed = C.hub_entry(F.col("path"), F.col("revision"), True, F.col("c_found"), F.col("c_http_status"),
                             F.col("c_disabled"), F.col("c_gated"), F.col("c_siblings"), F.col("c_detail"))
    return proceed & (F.coalesce(F.col("l_status"), F.lit("ok")) == "ok")


@session_cached
def c_columns_known(corpus_columns: tuple) -> Column:
    """The corpus has every column that the source reads."""
    return F.size(missing_columns(F.col("text_column"), F.col("text_template"), list(corpus_columns))) == 0


def source_findings(df: DataFrame, corpus_columns: list[str], sample_rows: int = K.DEFAULT_SAMPLE_ROWS,
                    timeout: float = 60.0) -> DataFrame:
    """CL4 in order, stopping at the first that applies: hub entry (CL1),
    timeout (CL3), load error (CL2), zero rows (FI5), missing columns (FI3),
    non-text values (FI4); then short and duplicate thresholds independently;
    'ok' only when the subject has no error.

    `df` has: subject, path, name, split, revision, text_column, text_template,
    the catalog columns (`with_catalog`), the load columns (`with_loads`) and
    the request statistics (nullable). Returns the input keys plus
    `findings ARRAY<STRUCT<ord, level, message>>` and `stats_ok`."""
    findings, stats_ok = _source_findings_cols(tuple(corpus_columns), sample_rows, timeout)
    return df.withColumn("findings", findings).withColumn("stats_ok", stats_ok)


@session_cached
def _source_findings_cols(corpus_columns: tuple, sample_rows: int, timeout: float):
    corpus_columns = list(corpus_columns)
    hub, proceed = C.hub_entry(F.col("path"), F.col("revision"), True, F.col("c_found"), F.col("c_http_status"),
                               F.col("c_disabled"), F.col("c_gated"), F.col("c_siblings"), F.col("c_detail"))
    status = F.coalesce(F.col("l_status"), F.lit("ok"))
    timed_out = proceed & (status == "timeout")
    failed = proceed & (status == "error")
    loaded = proceed & (status == "ok")
    rows = F.coalesce(F.col("rows"), F.lit(0))
    zero = loaded & (rows == 0)
    miss = missing_columns(F.col("text_column"), F.col("text_template"), corpus_columns)
    has_missing = loaded & ~zero & (F.size(miss) > 0)
    non_text = F.coalesce(F.col("non_text"), F.lit(0))
    not_text = loaded & ~zero & ~has_missing & truthy(F.col("text_column")) & (non_text > 0)
    stats_ok = loaded & ~zero & ~has_missing & ~not_text
    short, dup = F.col("short_share"), F.col("dup_share")
    ok_msg = F.when(truthy(F.col("text_column")), message(K.MSG_OK_COLUMN, column=F.col("text_column"), n=rows)) \
        .otherwise(message(K.MSG_OK_TEMPLATE, n=rows, columns=F.array_join(
            F.transform(template_columns(F.col("text_template")), quoted), ", ")))
    findings = F.concat(hub, F.filter(F.array(
        _fd(4, "error", message(K.MSG_STALL, detail=C.timeout_text(F.col("path"), sample_rows or 0, timeout)),
            timed_out),
        _fd(4, "error", message(K.MSG_CANNOT_STREAM, detail=C.load_error_text(
            F.col("path"), F.col("name"), F.col("split"), F.col("l_error_type"), F.col("l_error_msg"),
            F.col("known_pairs"), F.col("known_text"))), failed),
        _fd(4, "error", message(K.MSG_ZERO_ROWS, split=F.col("split")), zero),
        _fd(4, "error", message(K.MSG_MISSING_COLUMNS,
                                what=F.when(F.size(miss) == 1, F.lit("no column")).otherwise(F.lit("no columns")),
                                missing=F.array_join(F.transform(miss, quoted), ", "),
                                columns=_py_list(F.array_sort(F.array(*[F.lit(c) for c in corpus_columns])))),
            has_missing),
        _fd(4, "error", message(K.MSG_NON_TEXT, column=F.col("text_column"), k=non_text, n=rows), not_text),
        _fd(5, F.when(short > K.SHORT_ERROR_SHARE, F.lit("error")).otherwise(F.lit("warning")),
            F.when(short > K.SHORT_ERROR_SHARE, message(K.MSG_SHORT_ERROR, pct=percent(short)))
            .otherwise(message(K.MSG_SHORT_WARNING, pct=percent(short))),
            stats_ok & (short > K.SHORT_WARNING_SHARE)),
        _fd(6, F.when(dup > K.DUP_ERROR_SHARE, F.lit("error")).otherwise(F.lit("warning")),
            F.when(dup > K.DUP_ERROR_SHARE, message(K.MSG_DUP_ERROR, pct=percent(dup)))
            .otherwise(message(K.MSG_DUP_WARNING, pct=percent(dup))),
            stats_ok & (dup > K.DUP_WARNING_SHARE)),
        _fd(7, "ok", ok_msg,
            stats_ok & ~(short > K.SHORT_ERROR_SHARE) & ~(dup > K.DUP_ERROR_SHARE)),
    ), lambda x: x.isNotNull()))
    return findings, stats_ok


def benchmark_findings(df: DataFrame, has_registry: bool, sample_timeout: float = 60.0) -> DataFrame:
    return df.withColumn("findings", _benchmark_findings_col(has_registry, sample_timeout))


@session_cached
def _benchmark_findings_col(has_registry: bool, sample_timeout: float) -> Column:
    """CL5: hub entry (benchmark rules: no revision, gated only warns); load
    timeout → warning and continue, error → stop, zero rows → stop; then
    the harness: lm_eval task known / missing / unverified, eval_loss ok.

    `df` has: subject, ds_path, ds_name, ds_split, harness, task, catalog
    and load columns, `corpus_rows` (nullable) and `task_known` (nullable)."""
    hub, proceed = C.hub_entry(F.col("ds_path"), F.lit(None).cast("string"), False, F.col("c_found"),
                               F.col("c_http_status"), F.col("c_disabled"), F.col("c_gated"), F.col("c_siblings"), F.col("c_detail"))
    status = F.coalesce(F.col("l_status"), F.lit("ok"))
    timed_out = proceed & (status == "timeout")
    failed = proceed & (status == "error")
    empty = proceed & (status == "ok") & (F.coalesce(F.col("corpus_rows"), F.lit(0)) == 0)
    go = proceed & ~failed & ~empty
    lm = F.col("harness") == "lm_eval"
    task = F.col("task")
    if has_registry:
        known = F.coalesce(F.col("task_known"), F.lit(False))
        lm_find = [
            _fd(6, "error", message(K.MSG_NO_TASK.replace("{task!r}", "{task}"), task=py_repr_or_none(task)),
                go & lm & ~known),
            _fd(6, "ok", message(K.MSG_TASK_KNOWN.replace("{task!r}", "{task}"), path=F.col("ds_path"),
                                 split=F.col("ds_split"), task=py_repr_or_none(task)), go & lm & known),
        ]
    else:
        lm_find = [_fd(6, "ok", message(K.MSG_TASK_UNVERIFIED.replace("{task!r}", "{task}"), path=F.col("ds_path"),
                                        split=F.col("ds_split"), task=py_repr_or_none(task)), go & lm)]
    findings = F.concat(hub, F.filter(F.array(
        _fd(4, "warning", message(K.MSG_BENCH_TIMEOUT, detail=C.timeout_text(F.col("ds_path"), 1, sample_timeout)),
            timed_out),
        _fd(4, "error", message(K.MSG_BENCH_UNREADABLE, detail=C.load_error_text(
            F.col("ds_path"), F.col("ds_name"), F.col("ds_split"), F.col("l_error_type"), F.col("l_error_msg"),
            F.col("known_pairs"), F.col("known_text"))), failed),
        _fd(5, "error", message(K.MSG_BENCH_EMPTY, split=F.col("ds_split"), path=F.col("ds_path")), empty),
        *lm_find,
        _fd(6, "ok", message(K.MSG_HELD_OUT_LOSS, path=F.col("ds_path"), split=F.col("ds_split")), go & ~lm),
    ), lambda x: x.isNotNull()))
    return findings


SPEC = ["path", "name", "split", "revision", "text_column", "text_template", "seq_len"]
STATS = ["rows", "non_text", "median_chars", "short_share", "dup_share", "long_share"]


def check(sources: DataFrame | None, benchmarks: DataFrame | None, catalog: DataFrame, loads: DataFrame,
          splits: DataFrame | None, corpora: Corpora, tasks: DataFrame | None = None,
          timeout: float = 60.0) -> tuple[DataFrame | None, DataFrame | None]:
    """CL4 for every source (with subject and the SPEC columns) and CL5 for every benchmark (name, harness,
    task, ds_path, ds_name, ds_split), from one pass over the corpora.

    A source's verdict depends only on its spec, and many manifests name the same corpora, so verdicts are
    computed once per distinct spec and joined back. What cannot be rendered (a missing column) and benchmarks
    ask for row counts only. `tasks(task)` is the task registry, or None when none is installed."""
    asked = [*corpora.asked, "text_column", "text_template", "seq_len"]
    requests, specs, bench = [], None, None
    if sources is not None:
        specs = C.with_catalog(sources.select(*SPEC).distinct(), "path", catalog, F.col("revision"))
        specs = C.with_loads(specs, "path", loads, splits, F.col("name"), F.col("split"), F.col("revision"))
        known = c_columns_known(tuple(corpora.columns))
        specs = sized(corpora.named(specs, "path", "name", "split", F.col("revision")).withColumns(
            {f"q_{c}": F.when(known, F.col(c)) for c in asked[-3:]}).withColumn("looked_at", c_loaded()), "specs")
        requests.append(specs.where("looked_at").select(*corpora.asked, *[F.col(f"q_{c}").alias(c) for c in asked[-3:]]))
    if benchmarks is not None:
        bench = benchmarks.withColumn("subject", benchmark_subject(F.col("name")))
        bench = C.with_loads(C.with_catalog(bench, "ds_path", catalog), "ds_path", loads, splits, F.col("ds_name"),
                             F.col("ds_split"))
        bench = corpora.named(bench, "ds_path", "ds_name", "ds_split", F.lit(None).cast("string"))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(asked[-3:], ("string", "string", "int"))]
        requests.append(bench.select(*corpora.asked, *nothing))
    if specs is None:
        counts = row_counts(requests[0], corpora)
    elif bench is None:
        stats = sized(profile(requests[0], corpora), "stats")  # its bytes decide whether the specs are shuffled for it
    else:
        stats = sized(profile(requests[0].unionByName(requests[1]), corpora), "stats")
        counts = stats.where(" and ".join(f"{c} is null" for c in asked[-3:])).select(*corpora.asked, "rows")
    if specs is not None:
        found = stats.select(*corpora.asked, *[F.col(c).alias(f"q_{c}") for c in asked[-3:]], *STATS)
        specs = null_safe_join(specs, found, [*corpora.asked, *[f"q_{c}" for c in asked[-3:]]], "left")
        verdicts = source_findings(specs, corpora.columns, corpora.sample_rows or K.DEFAULT_SAMPLE_ROWS, timeout).select(
            *SPEC, "findings", "stats_ok", "rows", "median_chars", "short_share", "dup_share", "long_share")
        specs = null_safe_join(sources, verdicts, SPEC, "left")
    if bench is not None:
        bench = null_safe_join(bench, counts.withColumnRenamed("rows", "corpus_rows"), corpora.asked, "left").drop(*corpora.asked)
        if tasks is not None:
            t = tasks.select(F.col("task").alias("t_task"), F.lit(True).alias("task_known")).distinct()
            bench = bench.join(t, bench.task == t.t_task, "left").drop("t_task")
        else:
            bench = bench.withColumn("task_known", F.lit(None).cast("boolean"))
        bench = benchmark_findings(bench, has_registry=tasks is not None, sample_timeout=timeout)
    return specs, bench


def check_sources(sources: DataFrame, catalog: DataFrame, loads: DataFrame, splits: DataFrame | None,
                  corpora: Corpora, timeout: float = 60.0) -> DataFrame:
    """CL4 for every source."""
    return check(sources, None, catalog, loads, splits, corpora, None, timeout)[0]


def check_benchmarks(benchmarks: DataFrame, catalog: DataFrame, loads: DataFrame, splits: DataFrame | None,
                     corpora: Corpora, tasks: DataFrame | None, timeout: float = 60.0) -> DataFrame:
    """CL5 for every benchmark."""
    return check(None, benchmarks, catalog, loads, splits, corpora, tasks, timeout)[1]
