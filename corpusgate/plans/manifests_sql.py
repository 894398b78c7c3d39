"""Oracle SQL (DuckDB) for the manifest-rule queries.

A relational formulation, independent of the Column rules: flat fixture
rows, one SELECT per rule, gating by NOT EXISTS over the lower level.
"""
from __future__ import annotations

from corpusgate.plans.corpus import template_cols_sql, template_valid_sql
from corpusgate.sources.fixtures import cte

HUB_RE = "'[A-Za-z0-9][0-9A-Za-z_.-]*/[0-9A-Za-z_.-]+'"
NAME_RE = "'exp_[a-z0-9]+(?:_[a-z0-9]+)*'"
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}]"
TAKEN = "('exp_math', 'exp_dummy', 'exp_c4_p02', 'exp_legal', 'exp_nemotron_c4', 'exp_txt360_c4')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def q(x: str) -> str:
    """Python repr of a string (single quotes)."""
    return f"('''' || {x} || '''')"


def repr_none(x: str) -> str:
    return f"(case when {x} is null then 'None' else {q(x)} end)"


def detail_sql(t: str) -> str:
    toks = f"regexp_extract_all({t}, '\\{{\\{{|\\}}\\}}|\\{{[^{{}}]*\\}}|\\{{|\\}}|[^{{}}]+')"
    inner = "substr(tok, 2, length(tok) - 2)"
    name = f"regexp_extract({inner}, '^([^!:.\\[]*)', 1)"
    body = f"""case
      when tok = '}}' then 'Single ''}}'' encountered in format string'
      when tok = '{{' and k = len({toks}) then 'Single ''{{'' encountered in format string'
      when tok = '{{' then 'expected ''}}'' before end of string'
      when tok like '{{%}}' and tok not in ('{{{{', '}}}}') and {inner} = ''
        then 'Replacement index 0 out of range for positional args tuple'
      when tok like '{{%}}' and tok not in ('{{{{', '}}}}') and regexp_full_match({name}, '[0-9]+')
        then 'Replacement index ' || {name} || ' out of range for positional args tuple'
      when tok like '{{%}}' and tok not in ('{{{{', '}}}}') and not list_contains({template_cols_sql(t)}, {name})
        then {q(name)}
      when tok like '{{%}}' and tok not in ('{{{{', '}}}}') and contains({inner}, '[') then 'string index out of range'
      when tok like '{{%}}' and tok not in ('{{{{', '}}}}') and contains({inner}, '.')
        then '''str'' object has no attribute ' || {q(f"regexp_extract({inner}, '\\.([^.\\[]*)', 1)")}
    end"""
    return (f"coalesce(list_filter(list_transform({toks}, lambda tok, k: {body}), lambda d: d is not null)[1], "
            "'invalid format string')")


BASE = cte("fx_manifests", "fx_sources", "fx_benchmarks", "fx_changes") + f""",
ns as (select manifest_id, count(*) as n from fx_sources group by manifest_id),
nb as (select manifest_id, count(*) as n from fx_benchmarks group by manifest_id),
m as (select f.*, coalesce(ns.n, 0) as n_sources, coalesce(nb.n, 0) as n_benchmarks
      from fx_manifests f left join ns using (manifest_id) left join nb using (manifest_id)),
s as (select x.*, cast(x.pos - 1 as integer) as i, 'data.dataset_sources.' || cast(x.pos - 1 as varchar) as base
      from fx_sources x join m using (manifest_id) where m.n_sources between 1 and 4),
s_err as (
  select manifest_id, i as item, 1 as sub, base || '.path' as loc,
         'Value error, ' || {q('path')} || ' is not a HuggingFace dataset id like ''org/name''' as msg
  from s where not regexp_full_match(path, {HUB_RE})
  union all
  select manifest_id, i, 4, base || '.weight', 'Input should be greater than 0' from s where weight <= 0
  union all
  select manifest_id, i, 4, base || '.weight', 'Input should be less than or equal to 1' from s
  where weight > 1 or isnan(weight)
  union all
  select manifest_id, i, 7, base || '.revision', 'Value error, revision must be a full 40-character commit sha'
  from s where revision is not null and not regexp_full_match(revision, '[0-9a-f]{{40}}')),
s_after as (
  select manifest_id, i as item, 9 as sub, base as loc, 'Value error, ' || path || case
      when (coalesce(text_column, '') <> '') = (coalesce(text_template, '') <> '') then
        ': set either `text_column` (the column is the text) or `text_template` (several columns rendered into one), not both and not neither'
      when len({template_cols_sql('text_template')}) = 0 then
        ': text_template has no {{column}} placeholder — use text_column if the text is one column'
      when not {template_valid_sql('text_template')} then
        ': text_template is not a valid format string (' || {detail_sql('text_template')} || ')'
    end as msg
  from s where not exists (select 1 from s_err e where e.manifest_id = s.manifest_id and e.item = s.i)),
data_field as (
  select manifest_id, 5 as sec, 0 as item, 0 as sub, 'data.dataset_sources' as loc,
    case when n_sources < 1 then 'List should have at least 1 item after validation, not 0'
         else 'List should have at most 4 items after validation, not ' || cast(n_sources as varchar) end as msg
  from m where n_sources < 1 or n_sources > 4
  union all
  select manifest_id, 5, 1000, 0, 'data.sequence_length',
    'Value error, sequence_length must be one of (1024, 2048, 4096)'
  from m where sequence_length not in (1024, 2048, 4096)
  union all select manifest_id, 5, item, sub, loc, msg from s_err
  union all select manifest_id, 5, item, sub, loc, msg from s_after where msg is not null),
w as (select manifest_id, list_reduce(list(weight order by pos), lambda a, b: a + b) as total
      from s group by manifest_id),
rep as (select a.manifest_id, min(a.pos) as pos from s a join s b
          on a.manifest_id = b.manifest_id and b.pos < a.pos and a.path is not distinct from b.path
         and a.name is not distinct from b.name and a.split is not distinct from b.split
        group by a.manifest_id),
data_after as (
  select w.manifest_id, 5 as sec, 1001 as item, 0 as sub, 'data' as loc,
    case when abs(w.total - 1.0) > 1e-6
           then 'Value error, dataset_sources weights must sum to 1.0 (they sum to ' || printf('%g', w.total) || ')'
         else 'Value error, dataset source (' || {repr_none('s.path')} || ', ' || {repr_none('s.name')} || ', '
              || {repr_none('s.split')} || ') is listed twice' end as msg
  from w left join rep using (manifest_id) left join s on s.manifest_id = rep.manifest_id and s.pos = rep.pos
  where not exists (select 1 from data_field d where d.manifest_id = w.manifest_id)
    and (abs(w.total - 1.0) > 1e-6 or rep.pos is not null)),
b as (select x.*, cast(x.pos - 1 as integer) as i, 'benchmarks.' || cast(x.pos - 1 as varchar) as base
      from fx_benchmarks x join m using (manifest_id) where m.n_benchmarks between 1 and 5),
b_err as (
  select manifest_id, i as item, 2 as sub, base || '.harness' as loc,
         'Input should be ''lm_eval'' or ''eval_loss''' as msg from b where harness not in ('lm_eval', 'eval_loss')
  union all
  select manifest_id, i, 4, base || '.num_fewshot', 'Input should be greater than or equal to 0' from b
  where num_fewshot < 0
  union all
  select manifest_id, i, 7, base || '.dataset.path',
         'Value error, ' || {q('ds_path')} || ' is not a HuggingFace dataset id like ''org/name'''
  from b where not regexp_full_match(ds_path, {HUB_RE})
  union all
  select manifest_id, i, 8, base || '.dataset.split', 'Field required' from b where ds_split is null),
b_after as (
  select manifest_id, i as item, 9 as sub, base as loc, 'Value error, benchmark ' || {q('name')} || case
      when harness = 'lm_eval' and coalesce(task, '') = '' then ': an lm_eval benchmark needs `task`'
      when harness = 'lm_eval' and num_fewshot is null then ': an lm_eval benchmark needs `num_fewshot`'
      when harness <> 'lm_eval' and (coalesce(task, '') <> '' or num_fewshot is not null) then
        ': eval_loss has no lm-eval task or few-shot count; remove `task` / `num_fewshot`'
    end as msg
  from b where not exists (select 1 from b_err e where e.manifest_id = b.manifest_id and e.item = b.i)),
bench_err as (
  select manifest_id, 6 as sec, 0 as item, 0 as sub, 'benchmarks' as loc,
    case when n_benchmarks < 1 then 'List should have at least 1 item after validation, not 0'
         else 'List should have at most 5 items after validation, not ' || cast(n_benchmarks as varchar) end as msg
  from m where n_benchmarks < 1 or n_benchmarks > 5
  union all select manifest_id, 6, item, sub, loc, msg from b_err
  union all select manifest_id, 6, item, sub, loc, msg from b_after where msg is not null),
field_err as (
  select manifest_id, 1 as sec, 0 as item, 0 as sub, 'name' as loc,
    case when not regexp_full_match(name, {NAME_RE}) or length(name) > 40 then
      'Value error, name must look like exp_<words> (lowercase letters, digits, single underscores, at most 40 characters)'
    else 'Value error, ' || {q('name')} || ' is already a task on the subnet; pick another name' end as msg
  from m where not regexp_full_match(name, {NAME_RE}) or length(name) > 40 or name in {TAKEN}
  union all
  select manifest_id, 2, 0, 0, 'title', case when length(title) < 5 then 'String should have at least 5 characters'
    else 'String should have at most 80 characters' end from m where length(title) < 5 or length(title) > 80
  union all
  select manifest_id, 4, 0, 0, 'description', 'String should have at least 20 characters' from m
  where length({strip('description')}) < 20
  union all
  select manifest_id, 7, 0, 0, 'hypothesis', 'String should have at least 30 characters' from m
  where length({strip('hypothesis')}) < 30
  union all
  select manifest_id, 8, 0, 0, 'evidence', 'String should have at least 4 characters' from m
  where length({strip('evidence')}) < 4
  union all
  select manifest_id, 9, 0, 1, 'suggested_training.steps', 'Input should be greater than 0' from m where steps <= 0
  union all
  select manifest_id, 9, 0, 2, 'suggested_training.batch_size', 'Input should be greater than 0' from m
  where batch_size <= 0
  union all
  select manifest_id, 10, 0, 0, 'contamination', 'String should have at least 10 characters' from m
  where length({strip('contamination')}) < 10),
lower_err as (
  select * from field_err union all select * from data_field union all select * from data_after
  union all select * from bench_err),
dup_bench as (select manifest_id from fx_benchmarks group by manifest_id having count(distinct name) < count(*)),
held as (
  select manifest_id, name, ds_path, ds_split from (
    select x.*, row_number() over (partition by x.manifest_id order by x.pos) as rn from fx_benchmarks x
    where exists (select 1 from fx_sources y where y.manifest_id = x.manifest_id and y.path = x.ds_path
                  and y.name is not distinct from x.ds_name and y.split is not distinct from x.ds_split))
  where rn = 1),
held_msg as (
  select manifest_id, name, 'Value error, benchmark ' || {q('name')} || ' scores on ' || ds_path || ' split '
    || {q('ds_split')} || ', which is also a training source — the expert would be graded on data it trained on'
    as msg from held),
top_err as (
  select m.manifest_id, 11 as sec, 0 as item, 0 as sub, '(top level)' as loc,
    case when d.manifest_id is not null then 'Value error, benchmark names must be unique' else h.msg end as msg
  from m left join dup_bench d using (manifest_id) left join held_msg h using (manifest_id)
  where (d.manifest_id is not null or h.manifest_id is not null)
    and not exists (select 1 from lower_err e where e.manifest_id = m.manifest_id)),
file_err as (
  select manifest_id, 12 as sec, 0 as item, 1 as sub, cast(null as varchar) as loc,
    folder || '/' || file_stem || '.yaml: the file must be named after the proposal''s name (' || name || '.yaml)' as msg
  from m where name <> file_stem
  union all
  select manifest_id, 12, 0, 2, null,
    folder || '/' || file_stem || '.yaml: proposer.github is ' || {q('github')} || ' but the file is in ' || folder
    || '/ — the folder must be the proposer''s GitHub login'
  from m where lower(github) <> lower(folder)),
files as (select distinct folder, file_stem from fx_manifests),
dup_names as (
  select file_stem, file_stem || ': proposed by more than one person (' || string_agg(folder, ', ' order by folder)
    || '); task names must be unique' as msg
  from files group by file_stem having count(*) > 1)
"""

SUBJECT = "(s.path || case when coalesce(s.name, '') <> '' then ' [' || s.name || ']' else '' end || ' / ' || s.split)"

ORACLES = {
    "source_rules": BASE + f"""
select d.manifest_id, case when d.loc = 'data.dataset_sources' then null else {SUBJECT} end as subject,
  d.loc, d.msg as message
from data_field d left join s on s.manifest_id = d.manifest_id and s.i = d.item and d.loc <> 'data.dataset_sources'
where d.item < 1000""",
    "weight_sum": cte("fx_sources") + """
select manifest_id, count(*) as n_sources, round(sum(weight), 9) as total_weight,
  abs(sum(weight) - 1.0) <= 1e-6 as sums_to_one, printf('%g', sum(weight)) as total_text
from fx_sources group by manifest_id""",
    "duplicate_sources": cte("fx_sources") + """
select manifest_id, path, name, split, count(*) as copies from fx_sources
group by manifest_id, path, name, split having count(*) > 1""",
    "manifest_rules": BASE + """
select manifest_id, loc, msg as message from field_err
union all select manifest_id, loc, msg from data_field where item = 1000""",
    "benchmark_rules": BASE + """
select manifest_id, loc, msg as message from bench_err
union all select manifest_id, '(top level)', 'Value error, benchmark names must be unique' from dup_bench""",
    "heldout_violations": BASE + "select manifest_id, name as benchmark, msg as message from held_msg",
    "file_identity": BASE + "select manifest_id, msg as message from file_err",
    "taken_and_duplicate_names": BASE + f"""
select 'taken' as kind, cast(manifest_id as varchar) as key,
  'Value error, ' || {q('name')} || ' is already a task on the subnet; pick another name' as message
from fx_manifests where regexp_full_match(name, {NAME_RE}) and length(name) <= 40 and name in {TAKEN}
union all select 'duplicate', file_stem, msg from dup_names""",
    "all_problems": BASE + """,
allv as (select * from lower_err union all select * from top_err),
per_file as (
  select * from allv
  union all select f.* from file_err f where not exists (select 1 from allv a where a.manifest_id = f.manifest_id))
select 2 as phase, m.folder, m.file_stem || '.yaml' as file, p.manifest_id,
  cast(row_number() over (partition by p.manifest_id order by sec, item, sub, loc, msg) as integer) as seq,
  case when sec = 12 then msg else m.folder || '/' || m.file_stem || '.yaml: ' || loc || ': ' || msg end as problem
from per_file p join m using (manifest_id)
union all
select 3, null, file_stem, cast(null as bigint), 1, msg from dup_names
union all
select distinct 1, regexp_extract(rel, '^(.*)/[^/]*$', 1), regexp_extract(rel, '([^/]*)$', 1), cast(null as bigint), 1,
  'proposals/' || rel || ': only <github-login>/<task-name>.yaml files belong here'
from (select array_to_string(p[2:], '/') as rel, p from (
        select list_filter(string_split(path, '/'), lambda x: x <> '' and x <> '.') as p from fx_changes
        where not starts_with(path, '/')) a
      where p[1] = 'proposals' and len(p) > 1 and len(list_filter(p[2:], lambda x: starts_with(x, '.'))) = 0
        and not (len(p) = 3 and regexp_full_match(p[3], '.+\\.yaml'))) b""",
}

ORACLES["manifest_scan"] = BASE + """,
allv as (select * from lower_err union all select * from top_err),
per_file as (
  select * from allv
  union all select f.* from file_err f where not exists (select 1 from allv a where a.manifest_id = f.manifest_id))
select p.manifest_id,
  cast(row_number() over (partition by p.manifest_id order by sec, item, sub, loc, msg) as integer) as seq,
  case when sec = 12 then msg else m.folder || '/' || m.file_stem || '.yaml: ' || loc || ': ' || msg end as problem
from per_file p join m using (manifest_id)"""

ORACLES["find_manifest"] = cte("fx_manifests") + """
,
f as (select 'proposals' as root, folder, file_stem from fx_manifests
      union select 'examples', folder, file_stem from fx_manifests where manifest_id % 3 = 0),
n as (select file_stem as name from fx_manifests
      union select 'proposals/' || folder || '/' || file_stem || '.yaml' from fx_manifests where manifest_id % 50 = 0),
g as (select file_stem, min([root, folder, file_stem]) as parts from f group by file_stem)
select n.name, case when starts_with(n.name, 'proposals/') then n.name
  else g.parts[1] || '/' || g.parts[2] || '/' || g.parts[3] || '.yaml' end as path
from n left join g on g.file_stem = n.name"""

ORACLES["problem_reports"] = BASE + """,
allv as (select * from lower_err union all select * from top_err),
per_file as (
  select * from allv
  union all select f.* from file_err f where not exists (select 1 from allv a where a.manifest_id = f.manifest_id)),
lines as (
  select p.manifest_id, sec, item, sub, loc, msg,
    case when sec = 12 then msg else m.folder || '/' || m.file_stem || '.yaml: ' || loc || ': ' || msg end as problem
  from per_file p join m using (manifest_id))
select manifest_id, '### Proposal file check' || chr(10) || chr(10) || '❌ **The proposal file has problems:**'
  || chr(10) || chr(10) || string_agg('- ' || problem, chr(10) order by sec, item, sub, loc, msg) || chr(10) as markdown
from lines group by manifest_id"""

ODD = {  # oddity of `fx_tree` -> what the checks say about it
    1: "notes: Extra inputs are not permitted", 2: "data.dataset_sources.0.sha: Extra inputs are not permitted",
    3: "benchmarks.0.scorer: Extra inputs are not permitted", 4: "proposer.mail: Extra inputs are not permitted",
    6: "data.dataset_sources.0.weight: Input should be a valid number, unable to parse string as a number",
    7: "data.dataset_sources.0.weight: Input should be a valid number", 8: "title: Input should be a valid string",
    9: "title: Input should be a valid string",
    11: "data.sequence_length: Input should be a valid integer, got a number with a fractional part",
    12: "benchmarks.0.num_fewshot: Input should be a valid integer, unable to parse string as an integer",
    14: "benchmarks.0.higher_is_better: Input should be a valid boolean, unable to interpret input",
    16: "benchmarks.0.higher_is_better: Input should be a valid boolean, unable to interpret input",
    19: "suggested_training.steps: Input should be greater than 0",
    20: "benchmarks.0.dataset: Input should be a valid dictionary or instance of HubSplit",
    21: "proposer: Input should be a valid dictionary or instance of Proposer",
    22: "data.dataset_sources: Input should be a valid list", 23: "data: Field required",
    25: "not valid YAML — …", 26: "benchmarks.0.harness: Input should be 'lm_eval' or 'eval_loss'"}

ORACLES["manifest_files"] = cte("fx_tree") + """,
w as (select *, folder || '/' || stem || '.yaml: ' as label, case odd """ + "".join(
    f"when {k} then '{v.replace(chr(39), chr(39) * 2)}' " for k, v in ODD.items()) + """
  when 24 then stem || '.yaml: expected a mapping at the top level' end as wrong from fx_tree)
select 'proposals' as root, folder, file, case when wrong is not null then label || wrong
    when stem <> name then label || 'the file must be named after the proposal''s name (' || name || '.yaml)' else '' end as problems,
  case odd when 17 then '99999999999' when 18 then '123456789012345678901234' when 19 then '-99999999999' when 24 then null when 25 then null
    else '2000' end as steps,
  case odd when 27 then '1' when 24 then null when 25 then null else '512' end as batch_size,
  case odd when 12 then null when 13 then '99999999999' when 24 then null when 25 then null else '5' end as num_fewshot
from w where file like '%.yaml' and folder not like '.%'"""
