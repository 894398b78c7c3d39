"""Corpus-profiling queries over the input tables, with their oracle SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.render import compile_template, render_column, template_columns, template_is_valid
from corpusgate.functions.text import sql_message
from corpusgate.operators import profile as P
from corpusgate.operators.verdict import source_stat_verdicts
from corpusgate.sources.fixtures import cte, fixture
from corpusgate.sources.tables import table

PAIR_TEMPLATE = "User: {question}\n\nAssistant: {answer}"
SAMPLE_N = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def q_row_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", render_column("text").alias("text"))
    return P.row_stats(docs, ["source"])


def q_corpus_first_n(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", "doc_id")
    return P.first_n(docs, ["source"], ["doc_id"], SAMPLE_N, rank_col="rn")


def q_render_column(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source", render_column("text").alias("rendered"))


def pairs_rendered(spark, sf_dir):
    pairs = fixture(spark, sf_dir, "fx_pairs")
    return pairs.select("conv_id", "turn", compile_template(PAIR_TEMPLATE, pairs.schema).alias("rendered"))


def q_render_template(spark, sf_dir):
    return pairs_rendered(spark, sf_dir)


def q_row_stats_sampled(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", "doc_id", render_column("text").alias("text"))
    sample = P.first_n(docs, ["source"], ["doc_id"], SAMPLE_N)
    return P.row_stats(sample, ["source"])


def q_row_stats_template(spark, sf_dir):
    rendered = pairs_rendered(spark, sf_dir).withColumn("corpus", F.lit("fx_pairs"))
    return P.row_stats(rendered, ["corpus"], text="rendered", sequence_length=1024)


def q_source_verdicts(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("lang").alias("source"), render_column("text").alias("text"))
    stats = P.row_stats(docs, ["source"])
    return (source_stat_verdicts(stats, ["source"], F.col("source"), F.lit("text"))
            .select("source", "ord", "level", "message"))


def q_eval_gate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return P.eval_gate(docs, ["source"], "text", ["doc_id"]).select("source", "doc_id")


def q_duplicate_prefix_groups(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return P.duplicate_prefix_groups(docs, ["source"], "text", "doc_id")


def q_window_estimate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("lang", render_column("text").alias("text"))
    return P.window_estimate(docs, ["lang"], sequence_length=1024)


def q_template_rules(spark, sf_dir):
    """PR3, PR4, MV7, MV8 over every distinct template the sources use."""
    src = fixture(spark, sf_dir, "fx_sources")
    t = src.where(F.col("text_template").isNotNull()).select("text_template").distinct()
    cols = template_columns("text_template")
    return t.select(
        "text_template",
        F.array_join(cols, ",").alias("columns"),
        F.size(cols).alias("n_columns"),
        template_is_valid("text_template").alias("formattable"),
    )


QUERIES = {
    "row_stats": q_row_stats,
    "corpus_first_n": q_corpus_first_n,
    "render_column": q_render_column,
    "render_template": q_render_template,
    "row_stats_sampled": q_row_stats_sampled,
    "row_stats_template": q_row_stats_template,
    "source_verdicts": q_source_verdicts,
    "eval_gate": q_eval_gate,
    "duplicate_prefix_groups": q_duplicate_prefix_groups,
    "window_estimate": q_window_estimate,
    "template_rules": q_template_rules,
}


# ----------------------------------------------------------------------------
# Oracles (DuckDB SQL). Written independently of the operators above.

def _stats_sql(table_sql: str, key: str, text: str, seq: int) -> str:
    n = "count(*)"
    ok = f"count(*) filter (where length({text}) >= 200)"
    return f"""
select {key}, {n} as rows,
  cast(floor(median(length({text}))) as bigint) as median_chars,
  1 - {ok} / {n} as short_share,
  case when {ok} = 0 then 0.0
       else 1 - count(distinct case when length({text}) >= 200 then substring({text}, 1, 200) end) / {ok} end
    as dup_share,
  count(*) filter (where length({text}) > {seq} * 4) / {n} as long_share
from {table_sql} group by {key}"""


_PAIR_SQL = "('User: ' || coalesce(question, 'None') || chr(10) || chr(10) || 'Assistant: ' || coalesce(answer, 'None'))"


def _pct(x: str) -> str:
    return f"(cast(cast(round_even({x} * 100, 0) as bigint) as varchar) || '%')"


_VERDICTS_SQL = f"""
with s as ({_stats_sql("(select lang, coalesce(text, '') as text from documents)", "lang", "text", 4096)})
select lang as source, 1 as ord, case when short_share > 0.5 then 'error' else 'warning' end as level,
  case when short_share > 0.5 then {sql_message(K.MSG_SHORT_ERROR, pct=_pct("short_share"))}
       else {sql_message(K.MSG_SHORT_WARNING, pct=_pct("short_share"))} end as message
from s where short_share > 0.1
union all
select lang, 2, case when dup_share > 0.3 then 'error' else 'warning' end,
  case when dup_share > 0.3 then {sql_message(K.MSG_DUP_ERROR, pct=_pct("dup_share"))}
       else {sql_message(K.MSG_DUP_WARNING, pct=_pct("dup_share"))} end
from s where dup_share > 0.05
union all
select lang, 3, 'ok', {sql_message(K.MSG_OK_COLUMN, column="'text'", n="rows")}
from s where not (short_share > 0.5 or dup_share > 0.3)
"""

# Template columns without look-behind (RE2): take every `{+name}` run and
# keep those opened by a single brace.
def template_cols_sql(t: str) -> str:
    raw = (f"list_filter(list_transform(list_filter(regexp_extract_all({t}, '\\{{+[^{{}}]+\\}}'), "
           "lambda m: substr(m, 2, 1) <> '{'), "
           "lambda m: trim(split_part(split_part(substr(m, 2, length(m) - 2), '.', 1), '[', 1))), lambda c: c <> '')")
    return f"list_filter({raw}, lambda c, i: list_position({raw}, c) = i)"


def template_valid_sql(t: str) -> str:
    fields = f"list_filter(regexp_extract_all({t}, '\\{{\\{{|\\}}\\}}|\\{{([^{{}}]+)\\}}', 1), lambda f: f <> '')"
    return (f"(regexp_full_match({t}, '(?:[^{{}}]|\\{{\\{{|\\}}\\}}|\\{{[^{{}}.\\[:!]+\\}})*') and "
            f"len(list_filter({fields}, lambda f: not list_contains({template_cols_sql(t)}, f) "
            f"or regexp_full_match(f, '[0-9]+'))) = 0)")


ORACLES = {
    "row_stats": _stats_sql("(select source, coalesce(text, '') as text from documents)", "source", "text", 4096),
    "corpus_first_n": """
select source, doc_id, cast(rn as integer) as rn from (
  select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents)
where rn <= 20""",
    "render_column": "select doc_id, source, coalesce(text, '') as rendered from documents",
    "render_template": cte("fx_pairs") + f"\nselect conv_id, turn, {_PAIR_SQL} as rendered from fx_pairs",
    "row_stats_sampled": _stats_sql("""(select source, coalesce(text, '') as text from (
        select *, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 20)""",
                                    "source", "text", 4096),
    "row_stats_template": cte("fx_pairs") + _stats_sql(
        f"(select 'fx_pairs' as corpus, {_PAIR_SQL} as rendered from fx_pairs)", "corpus", "rendered", 1024),
    "source_verdicts": _VERDICTS_SQL,
    "eval_gate": """
select source, doc_id from (
  select source, doc_id, row_number() over (partition by source, substring(text, 1, 200) order by doc_id) as rn
  from documents where length(text) >= 200)
where rn = 1""",
    "duplicate_prefix_groups": """
select source, substring(text, 1, 200) as prefix, count(*) as copies, min(doc_id) as first_doc_id
from documents where length(text) >= 200
group by source, substring(text, 1, 200) having count(*) > 1""",
    "template_rules": cte("fx_sources") + f"""
select text_template, array_to_string({template_cols_sql("text_template")}, ',') as columns,
  cast(len({template_cols_sql("text_template")}) as integer) as n_columns,
  {template_valid_sql("text_template")} as formattable
from (select distinct text_template from fx_sources where text_template is not null)""",
    "window_estimate": """
select lang, count(*) as rows, cast(sum(length(text)) as bigint) as chars, sum(length(text)) / 4 as approx_tokens,
  cast(sum(ceil(length(text) / (1024 * 4))) as bigint) as windows,
  count(*) filter (where length(text) > 1024 * 4) as over_window_rows
from documents group by lang""",
}
