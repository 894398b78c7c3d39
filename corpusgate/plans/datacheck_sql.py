"""Oracle SQL (DuckDB) for the data-check queries.

Flat and relational: every finding is one SELECT with its own condition.
The corpus store is `fx_store`; dataset `org/corpus-<k>` is its `'src' || (k % 20)`.
A request sees the rows of its config and split, at the pinned revision only those
added by then. Templates are rendered here only when they have no field
(the fixture's only template whose columns all exist).
"""
from __future__ import annotations

from corpusgate.plans.corpus import template_cols_sql
from corpusgate.plans.manifests_sql import BASE as MANIFEST_BASE
from corpusgate.plans.manifests_sql import q, repr_none, strip
from corpusgate.sources.fixtures import FIXTURE_SQL

K = "k_dataset, k_config, k_split, k_rev"
COLUMNS_TEXT = "['doc_id', 'lang', 'n_chars', 'source', 'text']"
COLUMNS_SQL = "['doc_id', 'lang', 'n_chars', 'source', 'text']"
SUBJECT = "(path || case when coalesce(name, '') <> '' then ' [' || name || ']' else '' end || ' / ' || split)"
SUBJECT_S = SUBJECT.replace("path", "s.path").replace("name", "s.name").replace("split", "s.split")
NON_DATA = ".md .gitattributes .png .jpg .jpeg .svg .py .txt .yaml".split()


def _pct(x: str) -> str:
    return f"(cast(cast(round_even({x} * 100, 0) as bigint) as varchar) || '%')"


def _fx(*names: str) -> str:
    return ",\n".join(f"{n} as ({FIXTURE_SQL[n].strip()})" for n in names)


def corpus_key(path: str, name: str, split: str, revision: str) -> str:
    """The four columns that name a corpus."""
    return (f"(case when regexp_full_match({path}, 'org/corpus-[0-9]+') then "
            f"'src' || cast(cast(regexp_extract({path}, 'org/corpus-([0-9]+)', 1) as bigint) % 20 as varchar) end) as k_dataset, "
            f"coalesce(nullif({name}, ''), 'default') as k_config, {split} as k_split, "
            f"coalesce(nullif({revision}, ''), 'head') as k_rev")


def seen(d: str, r: str) -> str:
    """A store row that a request sees."""
    return (f"{d}.dataset = {r}.k_dataset and {d}.config = {r}.k_config and {d}.split = {r}.k_split "
            f"and ({r}.k_rev = 'head' or {d}.added = {r}.k_rev)")


def load_on(path: str, name: str, split: str) -> str:
    return f"l.l_path = {path} and l.config = coalesce(nullif({name}, ''), 'default') and l.split = {split}"


def _data_files(sib: str) -> str:
    cond = " or ".join(f"ends_with(lower(f), '{s}')" for s in NON_DATA)
    return f"list_filter({sib}, lambda f: not ({cond}))"


COMMON = f"""
cat as (select path as c_path, revision as c_rev, http_status, detail, disabled, gated, string_split(sibling_list, ',') as siblings
        from fx_catalog),
known as (select path as k_path, list(struct_pack(config := config, split := split)) as pairs,
            list_sort(list_distinct(list('name=''' || config || ''' split=''' || split || ''''))) as txt
          from fx_splits group by path),
loads as (select path as l_path, config, split, status, error_type, error_msg,
            {strip("error_type || ': ' || coalesce(error_msg, '')")} as raw_msg from fx_loads),
fx_store as ({FIXTURE_SQL["fx_store"].strip()}),
counts as (select dataset, config, split, 'head' as rev, count(*) as corpus_rows from fx_store group by 1, 2, 3
  union all select dataset, config, split, added, count(*) from fx_store where added <> 'later' group by 1, 2, 3, 4)"""


def load_text(path: str, name: str, split: str) -> str:
    msg = "(case when length(l.raw_msg) > 300 then substr(l.raw_msg, 1, 300) || '…' else l.raw_msg end)"
    cfg = f"coalesce(nullif({name}, ''), 'default')"
    return f"""(case
      when k.pairs is not null and len(k.pairs) > 0
           and len(list_filter(k.pairs, lambda p: p.config = {cfg} and p.split = {split})) = 0
        then {msg} || '. The Hub lists: ' || array_to_string(k.txt[1:12], ', ')
      when contains(coalesce(l.error_msg, ''), 'scripts are no longer supported')
        then {path} || ' uses a loading script, which current `datasets` refuses to run. Use a parquet export.'
      else {msg} end)"""


def _hub_rows(table: str, path: str, rev: str | None, training: bool) -> str:
    what = (f"(case when coalesce({rev}, '') <> '' then 'revision ' || {rev} || ' of ' || {path} else {path} end)"
            if rev else path)
    data = _data_files("c.siblings")
    on = f"c.c_path = {path} and c.c_rev is not distinct from " + (f"nullif({rev}, '')" if rev else "null")
    rows = f"""
  select t.*, 1 as ord, 'error' as level, {what} || ' does not exist on the Hub (or is private)' as message
  from {table} t left join cat c on {on} where c.c_path is null or c.http_status in (401, 404)
  union all
  select t.*, 1, 'error', 'the Hub answered ' || cast(c.http_status as varchar) || ' for ' || {path}
  from {table} t join cat c on {on} where c.http_status not in (401, 404, 200)
  union all
  select t.*, 1, 'error', 'could not reach the Hub: ' || coalesce(c.detail, '')
  from {table} t join cat c on {on} where c.http_status is null
  union all
  select t.*, 1, 'error', {path} || ' is disabled on the Hub'
  from {table} t join cat c on {on} where c.http_status = 200 and c.disabled"""
    if training:
        rows += f"""
  union all
  select t.*, 2, 'warning', {path} || ' is published as ' || cast(len({data}) as varchar) || ' file(s) ('
    || array_to_string(({data})[1:2], ', ') || ') in a format a streaming reader cannot read a piece at a time; '
    || 'every miner would pull and parse the whole file each round. Prefer a parquet-sharded export.'
  from {table} t join cat c on {on}
  where c.http_status = 200 and not c.disabled and len({data}) between 1 and 2
    and len(list_filter({data}, lambda f: ends_with(lower(f), '.parquet') or ends_with(lower(f), '.arrow'))) = 0
  union all
  select t.*, 3, 'warning', {path} || ' is gated (' || c.gated || '): every miner and validator must accept its '
    || 'terms on HuggingFace before the task runs. Its rows were not checked.'
  from {table} t join cat c on {on}
  where c.http_status = 200 and not c.disabled and coalesce(c.gated, '') <> ''"""
    else:
        rows += f"""
  union all
  select t.*, 3, 'warning', {path} || ' is gated (' || c.gated || '); the owner needs access to score it'
  from {table} t join cat c on {on}
  where c.http_status = 200 and not c.disabled and coalesce(c.gated, '') <> ''"""
    return rows


def _source_chain(src_table: str) -> str:
    """CTEs `hub_s`, `src_x` (proceed/status/stats), `src_find` for sources in `src_table`."""
    tcols = template_cols_sql("x.text_template")
    used = f"(case when coalesce(x.text_column, '') <> '' then [x.text_column] else {tcols} end)"
    missing = f"list_filter({used}, lambda c: not list_contains({COLUMNS_SQL}, c))"
    return f"""
hub_s as ({_hub_rows(src_table, "t.path", "t.revision", True)}),
src_p as (
  select s.*, coalesce(c.c_path is not null and c.http_status = 200 and not c.disabled and coalesce(c.gated, '') = '',
                       false) as proceed, {corpus_key("s.path", "s.name", "s.split", "s.revision")},
         coalesce(l.status, 'ok') as status,
         {load_text("s.path", "s.name", "s.split")} as load_msg
  from {src_table} s left join cat c on c.c_path = s.path and c.c_rev is not distinct from nullif(s.revision, '')
  left join loads l on {load_on("s.path", "s.name", "s.split")}
  left join known k on k.k_path = s.path),
src_m as (select x.*, {missing} as missing from src_p x),
req as (select distinct {K}, text_column, text_template, seq_len from src_m
        where proceed and status = 'ok' and len(missing) = 0),
req_rows as (
  select r.*, case when coalesce(r.text_column, '') <> '' then coalesce(d.text, '')
                   else replace(replace(r.text_template, '{{{{', '{{'), '}}}}', '}}') end as txt,
         d.text is null as null_text
  from req r join fx_store d on {seen("d", "r")}),
req_stats as (
  select {K}, text_column, text_template, seq_len, count(*) as rows,
    count(*) filter (where null_text and coalesce(text_column, '') <> '') as non_text,
    cast(floor(median(length(txt))) as bigint) as median_chars,
    1 - count(*) filter (where length(txt) >= 200) / count(*) as short_share,
    case when count(*) filter (where length(txt) >= 200) = 0 then 0.0
         else 1 - count(distinct case when length(txt) >= 200 then substring(txt, 1, 200) end)
                  / count(*) filter (where length(txt) >= 200) end as dup_share,
    count(*) filter (where length(txt) > seq_len * 4) / count(*) as long_share
  from req_rows group by {K}, text_column, text_template, seq_len),
src_x as (
  select m.*, coalesce(st.rows, cn.corpus_rows, 0) as n_rows, coalesce(cn.corpus_rows, 0) as c_rows,
         coalesce(st.non_text, 0) as n_non_text, st.median_chars, st.short_share, st.dup_share, st.long_share
  from src_m m left join req_stats st on st.k_dataset = m.k_dataset and st.k_config = m.k_config and st.k_split = m.k_split
    and st.k_rev = m.k_rev and st.text_column is not distinct from m.text_column
    and st.text_template is not distinct from m.text_template and st.seq_len = m.seq_len
  left join counts cn on cn.dataset = m.k_dataset and cn.config = m.k_config and cn.split = m.k_split and cn.rev = m.k_rev),
src_s as (
  select x.*, proceed and status = 'ok' and c_rows > 0 and len(missing) = 0
           and not (coalesce(text_column, '') <> '' and n_non_text > 0) as stats_ok
  from src_x x),
src_find as (
  select manifest_id, pos, subject, ord, level, message from hub_s
  union all
  select manifest_id, pos, subject, 4, 'error', 'streaming 200 rows of ' || path
    || ' took longer than 60s; a miner''s dataloader would stall the same way' from src_s
  where proceed and status = 'timeout'
  union all
  select manifest_id, pos, subject, 4, 'error', 'cannot be streamed: ' || load_msg from src_s
  where proceed and status = 'error'
  union all
  select manifest_id, pos, subject, 4, 'error', 'split ' || {q("split")} || ' streamed zero rows' from src_s
  where proceed and status = 'ok' and c_rows = 0
  union all
  select manifest_id, pos, subject, 4, 'error',
    case when len(missing) = 1 then 'no column ' else 'no columns ' end
    || array_to_string(list_transform(missing, lambda c: '''' || c || ''''), ', ')
    || '; the columns are {COLUMNS_TEXT.replace("'", "''")}' from src_s
  where proceed and status = 'ok' and c_rows > 0 and len(missing) > 0
  union all
  select manifest_id, pos, subject, 4, 'error', {q("text_column")} || ' is not text in '
    || cast(n_non_text as varchar) || ' of ' || cast(n_rows as varchar)
    || ' rows; use a text column, or a text_template that renders one' from src_s
  where proceed and status = 'ok' and c_rows > 0 and len(missing) = 0 and coalesce(text_column, '') <> ''
    and n_non_text > 0
  union all
  select manifest_id, pos, subject, 5, case when short_share > 0.5 then 'error' else 'warning' end,
    case when short_share > 0.5 then {_pct("short_share")} || ' of sampled rows are under 200 characters; '
      || 'the validator''s eval drops those, so there would be too little to score on'
    else {_pct("short_share")} || ' of sampled rows are under 200 characters and would be dropped from evaluation'
    end from src_s where stats_ok and short_share > 0.1
  union all
  select manifest_id, pos, subject, 6, case when dup_share > 0.3 then 'error' else 'warning' end,
    case when dup_share > 0.3 then {_pct("dup_share")} || ' of sampled rows share their first 200 characters '
      || 'with another row; the eval would measure memorising a few documents'
    else {_pct("dup_share")} || ' of sampled rows share a 200-character prefix' end
  from src_s where stats_ok and dup_share > 0.05
  union all
  select manifest_id, pos, subject, 7, 'ok', 'streams, and ' || case when coalesce(text_column, '') <> ''
      then {q("text_column")} || ' is usable text ('
      else 'text_template over ' || array_to_string(list_transform({tcols.replace("x.", "")},
                                                    lambda c: '''' || c || ''''), ', ')
           || ' renders usable text (' end || cast(n_rows as varchar) || ' rows sampled)'
  from src_s where stats_ok and not (short_share > 0.5) and not (dup_share > 0.3))"""


_TASKS = f"""  union all
  select manifest_id, pos, 'benchmark ' || name, 6, 'error', 'lm-eval has no task ' || {repr_none("task")}
    || '. If it is a custom task, say so in the PR and include its YAML; the owner will review it.'
  from b_go where go and harness = 'lm_eval' and not task_known
  union all
  select manifest_id, pos, 'benchmark ' || name, 6, 'ok', ds_path || ' / ' || ds_split
    || ' is readable and lm-eval knows ' || {repr_none("task")} from b_go
  where go and harness = 'lm_eval' and task_known
"""

_NO_REGISTRY = f"""  union all
  select manifest_id, pos, 'benchmark ' || name, 6, 'ok', ds_path || ' / ' || ds_split || ' is readable (lm-eval task '
    || {repr_none("task")} || ' not verified: lm-eval is not installed)' from b_go where go and harness = 'lm_eval'
"""


def _bench_chain(b_table: str, registry: bool = True) -> str:
    return f"""
hub_b as ({_hub_rows(b_table, "t.ds_path", None, False)}),
b_s as (
  select b.*, coalesce(c.c_path is not null and c.http_status = 200 and not c.disabled, false) as proceed,
    coalesce(l.status, 'ok') as status, coalesce(n.corpus_rows, 0) as corpus_rows,
    tk.task is not null as task_known,
    {load_text("b.ds_path", "b.ds_name", "b.ds_split")} as load_msg
  from (select b0.*, {corpus_key("ds_path", "ds_name", "ds_split", "null::varchar")} from {b_table} b0) b
  left join cat c on c.c_path = b.ds_path and c.c_rev is null
  left join loads l on {load_on("b.ds_path", "b.ds_name", "b.ds_split")}
  left join known k on k.k_path = b.ds_path left join counts n on n.dataset = b.k_dataset and n.config = b.k_config and n.split = b.k_split and n.rev = b.k_rev
  left join (select distinct task from fx_tasks) tk on tk.task = b.task),
b_go as (select *, proceed and status <> 'error' and not (status = 'ok' and corpus_rows = 0) as go from b_s),
b_find as (
  select manifest_id, pos, 'benchmark ' || name as subject, ord, level, message from hub_b
  union all
  select manifest_id, pos, 'benchmark ' || name, 4, 'warning', 'streaming 1 rows of ' || ds_path
    || ' took longer than 60s; could not confirm the split is readable' from b_s
  where proceed and status = 'timeout'
  union all
  select manifest_id, pos, 'benchmark ' || name, 4, 'error', 'scored split cannot be read: ' || load_msg from b_s
  where proceed and status = 'error'
  union all
  select manifest_id, pos, 'benchmark ' || name, 5, 'error', 'split ' || {q("ds_split")} || ' of ' || ds_path
    || ' is empty' from b_s where proceed and status = 'ok' and corpus_rows = 0
{_TASKS if registry else _NO_REGISTRY}  union all
  select manifest_id, pos, 'benchmark ' || name, 6, 'ok', ds_path || ' / ' || ds_split
    || ' is readable for a held-out loss' from b_go where go and harness <> 'lm_eval')"""


FX_ALL = _fx("fx_manifests", "fx_sources", "fx_benchmarks", "fx_catalog", "fx_splits", "fx_loads", "fx_tasks")
SRC_ALL = f"""src_all as (select s.*, m.sequence_length as seq_len, {SUBJECT_S} as subject
  from fx_sources s join fx_manifests m using (manifest_id))"""

ORACLES = {
    "corpus_scan": f"""with {_fx("fx_store")}
select dataset, added, count(*) as rows, cast(sum(n_chars) as bigint) as chars, count(*) as ordinals
from fx_store where config = 'default' and split = 'validation' group by dataset, added""",
    "hub_entry_findings": f"with {FX_ALL}, {COMMON}, {SRC_ALL},\n"
                          f"hub_s as ({_hub_rows('src_all', 't.path', 't.revision', True)})\n"
                          "select manifest_id, pos, subject, ord, level, message from hub_s",
    "load_error_findings": f"""with {FX_ALL}, {COMMON}, {SRC_ALL}
select s.manifest_id, s.pos, s.subject, 'error' as level,
  case when l.status = 'timeout' then 'streaming 200 rows of ' || s.path
         || ' took longer than 60s; a miner''s dataloader would stall the same way'
       else 'cannot be streamed: ' || {load_text("s.path", "s.name", "s.split")} end as message
from src_all s join loads l on {load_on("s.path", "s.name", "s.split")} left join known k on k.k_path = s.path
where l.status in ('timeout', 'error')""",
    "source_findings": f"with {FX_ALL}, {COMMON}, {SRC_ALL}, {_source_chain('src_all')}\n"
                       "select manifest_id, pos, subject, ord, level, message from src_find",
    "benchmark_verdicts": f"with {FX_ALL}, {COMMON}, {_bench_chain('fx_benchmarks')}\n"
                          "select manifest_id, pos, subject, ord, level, message from b_find",
    "benchmark_verdicts_unverified": f"with {FX_ALL}, {COMMON}, {_bench_chain('fx_benchmarks', False)}\n"
                                     "select manifest_id, pos, subject, ord, level, message from b_find",
}

_VALID = """,
allv as (select * from lower_err union all select * from top_err),
valid as (select manifest_id, name from m where not exists (select 1 from allv a where a.manifest_id = m.manifest_id)
          and not exists (select 1 from file_err f where f.manifest_id = m.manifest_id)),
src_v as (select s.*, m.sequence_length as seq_len, """ + SUBJECT.replace("path", "s.path").replace(
    "name", "s.name").replace("split", "s.split") + """ as subject
  from fx_sources s join fx_manifests m using (manifest_id) where s.manifest_id in (select manifest_id from valid)),
bench_v as (select * from fx_benchmarks where manifest_id in (select manifest_id from valid))"""

ICON = "(case level when 'error' then '❌' when 'warning' then '⚠️' else '✅' end)"

ORACLES["proposal_report"] = (
    MANIFEST_BASE + ",\n" + _fx("fx_catalog", "fx_splits", "fx_loads", "fx_tasks") + ",\n" + COMMON + _VALID + ","
    + _source_chain("src_v") + "," + _bench_chain("bench_v") + f""",
allf as (select manifest_id, 0 as kind, pos, ord, subject, level, message from src_find
         union all select manifest_id, 1, pos, ord, subject, level, message from b_find),
agg as (select manifest_id,
          count(*) filter (where level = 'error') as errors, count(*) filter (where level = 'warning') as warnings,
          count(*) filter (where level = 'ok') as oks,
          string_agg('| ' || {ICON} || ' | `' || subject || '` | ' || replace(message, '|', '/') || ' |', chr(10)
                     order by kind, pos, ord, level, message) as lines
        from allf group by manifest_id),
st as (select manifest_id, string_agg('| `' || subject || '` | ' || cast(n_rows as varchar) || ' | '
          || format('{{:,}}', median_chars) || ' | ' || {_pct("short_share")} || ' | ' || {_pct("dup_share")} || ' | '
          || {_pct("long_share")} || ' |', chr(10) order by pos) as lines
       from src_s where stats_ok group by manifest_id)
select v.manifest_id, v.name, coalesce(a.errors, 0) = 0 as passed, cast(coalesce(a.errors, 0) as integer) as errors,
  cast(coalesce(a.warnings, 0) as integer) as warnings, cast(coalesce(a.oks, 0) as integer) as oks,
  '### Dataset check: `' || v.name || '`' || chr(10) || chr(10)
  || case when coalesce(a.errors, 0) = 0 then '✅ **The data can run.**' else '❌ **The data cannot run as proposed.**' end
  || chr(10) || chr(10) || '| | Subject | Result |' || chr(10) || '|---|---|---|'
  || coalesce(chr(10) || a.lines, '')
  || coalesce(chr(10) || chr(10) || '**Sampled rows**' || chr(10) || chr(10)
     || '| Source | Rows read | Median chars | Under 200 chars | Duplicate prefixes | Longer than one window |'
     || chr(10) || '|---|---|---|---|---|---|' || chr(10) || st.lines, '')
  || chr(10) as markdown
from valid v left join agg a using (manifest_id) left join st using (manifest_id)"""
)

ORACLES["check_outcome"] = ("with r as (" + ORACLES["proposal_report"] + """)
select bool_or(not passed) as failed, count(*) as manifests, sum(errors) as errors, sum(warnings) as warnings
from r""")

ORACLES["console_lines"] = (
    MANIFEST_BASE + ",\n" + _fx("fx_catalog", "fx_splits", "fx_loads", "fx_tasks") + ",\n" + COMMON + _VALID + ","
    + _source_chain("src_v") + "," + _bench_chain("bench_v") + """,
per_file as (
  select * from allv
  union all select f.* from file_err f where not exists (select 1 from allv a where a.manifest_id = f.manifest_id))
select p.manifest_id, 0 as phase, 0 as kind, 0 as pos,
  cast(row_number() over (partition by p.manifest_id order by sec, item, sub, loc, msg) - 1 as integer) as ord,
  '✗ ' || case when sec = 12 then msg else m.folder || '/' || m.file_stem || '.yaml: ' || loc || ': ' || msg end as line
from per_file p join m using (manifest_id)
union all
select v.manifest_id, 1, 0, 0, 0, '✓ 1 proposal(s) well-formed: ' || m.folder || '/' || m.file_stem || '.yaml'
from valid v join m using (manifest_id)
union all
select v.manifest_id, 1, 0, 0, 1, '… checking that ' || m.file_stem || '''s data can run (this streams from the Hub)'
from valid v join m using (manifest_id)
union all
select manifest_id, 2, kind, pos, ord, '  ' || case level when 'error' then '✗' when 'warning' then '!' else '✓' end
  || ' ' || subject || ': ' || message
from (select manifest_id, 0 as kind, pos, ord, subject, level, message from src_find
      union all select manifest_id, 1, pos, ord, subject, level, message from b_find) x""")

ORACLES["nontext_missing"] = """
with d as (select doc_id, lang, n_chars, source, case when doc_id % 53 = 0 then null else text end as text from documents),
p as (select distinct source as path from documents union all select 'src0_mirror'),
s as (select path, case when path in ('src3', 'src7') then 'contents' else 'text' end as tc from p),
st as (select source, count(*) as n, count(*) filter (where text is null) as nulls,
         1 - count(*) filter (where length(text) >= 200) / count(*) as short_share,
         case when count(*) filter (where length(text) >= 200) = 0 then 0.0
              else 1 - count(distinct case when length(text) >= 200 then substring(text, 1, 200) end)
                       / count(*) filter (where length(text) >= 200) end as dup_share
       from d group by source),
x as (select s.path, s.tc, coalesce(st.n, 0) as n, coalesce(st.nulls, 0) as nulls, st.short_share, st.dup_share
      from s left join st on st.source = s.path),
ok as (select *, n > 0 and tc = 'text' and nulls = 0 as stats_ok from x)
select path as source, 4 as ord, 'error' as level, 'split ''train'' streamed zero rows' as message from x where n = 0
union all
select path, 4, 'error', 'no column ''contents''; the columns are [''doc_id'', ''lang'', ''n_chars'', ''source'', ''text'']'
from x where n > 0 and tc = 'contents'
union all
select path, 4, 'error', '''text'' is not text in ' || cast(nulls as varchar) || ' of ' || cast(n as varchar)
  || ' rows; use a text column, or a text_template that renders one' from x where n > 0 and tc = 'text' and nulls > 0
union all
select path, 5, case when short_share > 0.5 then 'error' else 'warning' end,
  case when short_share > 0.5 then (cast(cast(round_even(short_share * 100, 0) as bigint) as varchar) || '%')
    || ' of sampled rows are under 200 characters; the validator''s eval drops those, so there would be too little to score on'
  else (cast(cast(round_even(short_share * 100, 0) as bigint) as varchar) || '%')
    || ' of sampled rows are under 200 characters and would be dropped from evaluation' end
from ok where stats_ok and short_share > 0.1
union all
select path, 6, case when dup_share > 0.3 then 'error' else 'warning' end,
  case when dup_share > 0.3 then (cast(cast(round_even(dup_share * 100, 0) as bigint) as varchar) || '%')
    || ' of sampled rows share their first 200 characters with another row; the eval would measure memorising a few documents'
  else (cast(cast(round_even(dup_share * 100, 0) as bigint) as varchar) || '%') || ' of sampled rows share a 200-character prefix' end
from ok where stats_ok and dup_share > 0.05
union all
select path, 7, 'ok', 'streams, and ''text'' is usable text (' || cast(n as varchar) || ' rows sampled)'
from ok where stats_ok and not (short_share > 0.5) and not (dup_share > 0.3)"""
