"""Derived fixtures: deterministic views over the input tables.

Each is one SQL text that Spark and DuckDB both accept, so an oracle can
inline it as a CTE. They give the nested-manifest, catalog and change-log
shapes at the scale of the input tables (see FIXTURES.md).
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusgate.sources.tables import table

FIXTURE_SQL = {
    "fx_manifests": """
select o_orderkey as manifest_id,
  concat('user', cast(o_custkey % 200 as string)) as folder,
  case when o_orderkey % 37 = 0 then 'exp_other' else concat('exp_', cast(o_orderkey % 14000 as string)) end as file_stem,
  case when o_orderkey % 19 = 1 then 'exp_math' when o_orderkey % 23 = 0 then concat('exp__', cast(o_orderkey as string))
       when o_orderkey % 29 = 0 then concat('Exp_', cast(o_orderkey as string))
       when o_orderkey % 31 = 0 then concat('exp_', repeat('a', 40))
       else concat('exp_', cast(o_orderkey % 14000 as string)) end as name,
  case when o_orderkey % 41 = 0 then repeat('t', 81) when o_orderkey % 43 = 0 then 'abc' else concat('Expert ', o_orderpriority) end as title,
  case when o_orderkey % 17 = 0 then 'somebody' when o_orderkey % 2 = 0 then concat('User', cast(o_custkey % 200 as string)) else concat('user', cast(o_custkey % 200 as string)) end as github,
  case when o_orderkey % 47 = 0 then concat('  ...', repeat(' ', 30)) else 'Train an expert on filings to improve an exam.' end as description,
  case when o_orderkey % 53 = 0 then 'it will' else 'The exam asks about filings, and the corpus is those filings.' end as hypothesis,
  case when o_orderkey % 59 = 0 then '... ' else 'none known' end as evidence,
  case when o_orderkey % 61 = 0 then 'no' else 'The test split is not part of the corpus.' end as contamination,
  case when o_orderkey % 5 = 0 then 2048 when o_orderkey % 67 = 0 then 3000 else 4096 end as sequence_length,
  case when o_orderkey % 3 = 0 then cast(null as int) when o_orderkey % 71 = 0 then 0 else 2000 end as steps,
  case when o_orderkey % 4 = 0 then cast(null as int) when o_orderkey % 73 = 0 then -1 else 512 end as batch_size
from orders
""",
    "fx_sources": """
select l_orderkey as manifest_id, cast(rn as int) as pos,
  concat(case when rn % 7 = 0 then '' else 'org/' end, 'corpus-',
    cast(case when l_orderkey % 10 = 4 and rn = 1 then l_orderkey else l_partkey end as string)) as path,
  case when l_returnflag = 'N' then cast(null as string) else lower(l_returnflag) end as name,
  case when l_linestatus = 'O' then 'train' else 'validation' end as split,
  l_quantity / sum(l_quantity) over (partition by l_orderkey) * case when l_orderkey % 11 = 0 then 1.5e0 else 1e0 end as weight,
  case when l_partkey % 3 = 0 then cast(null as string) else 'text' end as text_column,
  case when l_partkey % 17 = 0 then 'just words' when l_partkey % 51 = 3 then 'A {a} {b'
       when l_partkey % 3 = 0 then 'User: {question} Assistant: {answer}' end as text_template,
  case when l_partkey % 5 = 0 then repeat('0a', 20) when l_partkey % 29 = 1 then 'main' end as revision
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem) x
""",
    "fx_benchmarks": """
select o_orderkey as manifest_id, cast(k as int) as pos, concat('bench_', cast(case when o_orderkey % 8 = 0 then 0 else k end as string)) as name,
  case when o_orderkey % 83 = 0 then 'other' when o_orderstatus = 'F' then 'eval_loss' else 'lm_eval' end as harness,
  case when (o_orderstatus = 'F' and o_orderkey % 7 <> 0) or o_orderkey % 13 = 0 then cast(null as string) else concat('task_', cast(o_custkey % 20 as string)) end as task,
  case when o_orderstatus = 'F' or o_orderkey % 16 = 5 then cast(null as int) when o_orderkey % 79 = 0 then -1 else 5 end as num_fewshot,
  case when o_orderstatus = 'F' then 'loss' else 'acc' end as metric, (o_orderstatus <> 'F') as higher_is_better,
  concat('org/corpus-', cast(case when o_orderkey % 10 = 4 then o_orderkey else o_custkey + k end as string)) as ds_path, cast(null as string) as ds_name,
  case when o_orderkey % 2 = 0 then 'train' else 'validation' end as ds_split
from (select *, 1 as k from orders union all select *, 2 as k from orders where o_orderkey % 4 = 0) x
""",
    "fx_catalog": """
select path, cast(null as string) as revision, http_status, detail, disabled, gated, sibling_list from (
  select concat('org/corpus-', cast(p_partkey as string)) as path,
    case when p_size % 12 = 0 then 404 when p_size % 13 = 0 then 500 when p_size % 14 = 0 then cast(null as int) else 200 end as http_status,
    case when p_size % 14 = 0 then 'the read operation timed out' end as detail,
    (p_partkey % 10 = 3) as disabled,
    case when p_partkey % 7 = 0 then 'manual' when p_partkey % 7 = 1 then 'auto' end as gated,
    case when p_partkey % 4 = 0 then 'README.md,data.json' when p_partkey % 4 = 1 then 'README.md,a.jsonl,b.jsonl,c.jsonl'
         when p_partkey % 4 = 2 then 'README.MD,logo.PNG' else 'README.md,data/train-0.PARQUET' end as sibling_list
  from part) x
union all
select concat('org/corpus-', cast(p_partkey as string)), repeat('0a', 20), 200, cast(null as string), (p_partkey % 10 = 3),
  case when p_partkey % 7 = 0 then 'manual' when p_partkey % 7 = 1 then 'auto' end, 'README.md,data/train-0.PARQUET'
from part where p_partkey % 4 <> 1
""",
    "fx_splits": """
select concat('org/corpus-', cast(p_partkey as string)) as path, 'default' as config, 'train' as split from part where p_partkey % 5 <> 0
union all select concat('org/corpus-', cast(p_partkey as string)) as path, 'a' as config, 'validation' as split from part where p_partkey % 5 <> 0
union all select concat('org/corpus-', cast(p_partkey as string)) as path, 'r' as config, 'train' as split from part where p_partkey % 5 <> 0
""",
    "fx_loads": "\nunion all ".join(f"""
select concat('org/corpus-', cast(p_partkey as string)) as path, '{config}' as config, '{split}' as split,
  case when (p_partkey + {i}) % 6 = 1 then 'timeout' when (p_partkey + {i}) % 6 in (2, 4) then 'error' else 'ok' end as status,
  case when (p_partkey + {i}) % 6 = 2 then 'KeyError' when (p_partkey + {i}) % 6 = 4 then 'RuntimeError' end as error_type,
  case when (p_partkey + {i}) % 6 = 2 then repeat('train ', 80)
       when (p_partkey + {i}) % 6 = 4 then 'Dataset scripts are no longer supported, but found x.py' end as error_msg
from part""" for i, (config, split) in enumerate([
        ("default", "train"), ("a", "validation"), ("r", "train"), ("default", "validation"), ("a", "train"),
        ("r", "validation")])) + "\n",
    "fx_tasks": """
select distinct concat('task_', cast(p_partkey as string)) as task from part
""",
    "fx_changes": """
select pr_id, seq, author, case when pr_id % 9 = 0 then 'member' when pr_id % 9 = 1 then 'NONE'
    when pr_id % 9 = 2 then cast(null as string) else 'CONTRIBUTOR' end as association,
  case event_type when 'signup' then 'A' when 'error' then 'D' when 'purchase' then 'R' else 'M' end as status,
  concat(case when user_id % 10 = 0 then 'docs/' when user_id % 10 = 1 then 'proposals//' else 'proposals/' end,
         case when user_id % 4 = 0 then 'user1' when user_id % 4 = 1 then upper(author) else author end,
         case when user_id % 11 = 0 then '/nested' else '' end,
         case when user_id % 13 = 0 then '/.hid_' else '/exp_' end, cast(user_id as string),
         case when user_id % 14 = 1 then '.yml' else '.yaml' end) as path,
  case when event_type = 'purchase' then concat('proposals/', case when user_id % 3 = 0 then 'user2' else author end, '/exp_old.yaml') end as old_path
from (select cast(floor(event_id / 3) as bigint) as pr_id, cast(event_id % 3 as int) as seq, user_id, event_type,
        concat('user', cast(cast(floor(event_id / 3) as bigint) % 40 as string)) as author from events) x
""",
    "fx_prs": """
select pr_id, concat('user', cast(pr_id % 40 as string)) as author,
  case when pr_id % 9 = 0 then 'member' when pr_id % 9 = 1 then 'NONE' when pr_id % 9 = 2 then cast(null as string)
       else 'CONTRIBUTOR' end as association
from (select distinct cast(floor(event_id / 3) as bigint) as pr_id from events
      union all select cast(1000000000 + c_custkey as bigint) as pr_id from customer) x
""",
    # manifest files with one oddity each (`odd`), as JSON or as block YAML
    "fx_tree": """
select id, odd, folder, name, file, concat(folder, '/', file) as path, regexp_replace(file, '[.][^.]*$', '') as stem,
  case when odd = 24 then concat('- a', chr(10), '- b', chr(10)) when odd = 25 then concat('name: [a', chr(10), 'title: x', chr(10))
  when id % 2 = 0 then concat('{"name": "', name, '", "title": ', title, ', "proposer": ', proposer, ', "description": "', about,
    '", ', case when odd = 23 then '' else concat('"data": {"dataset_sources": ', case when odd = 22 then '{"a": 1}' else concat(
      '[{"path": "org/corpus", "weight": ', weight, ', "text_column": "text"', case when odd = 2 then ', "sha": 1' else '' end, '}]') end,
    ', "sequence_length": ', seq, '}, ') end, '"benchmarks": [{"name": "b", "harness": ', harness, ', "task": "t", "num_fewshot": ', shots,
    ', "metric": "acc", "higher_is_better": ', higher, ', "dataset": ', dataset, case when odd = 3 then ', "scorer": "x"' else '' end,
    '}], "hypothesis": "', about, '", "evidence": "none known", "suggested_training": {"steps": ', steps, ', "batch_size": ', batch,
    '}, "contamination": "', about, '"', case when odd = 1 then ', "notes": "x"' else '' end, '}')
  else concat('# a manifest as people write it', chr(10), 'name: ', name, chr(10), 'title: ', title, chr(10), 'proposer: ', proposer, chr(10),
    'description: >-', chr(10), '  ', about, chr(10), '  and more', chr(10),
    case when odd = 23 then '' else concat('data:', chr(10), '  dataset_sources:', chr(10), case when odd = 22 then concat('    a: 1', chr(10))
      else concat('  - path: org/corpus', chr(10), '    weight: ', weight, chr(10), '    text_column: text', chr(10),
        case when odd = 2 then concat('    sha: 1', chr(10)) else '' end) end, '  sequence_length: ', seq, chr(10)) end,
    'benchmarks:', chr(10), '- name: b', chr(10), '  harness: ', harness, chr(10), '  task: t', chr(10), '  num_fewshot: ', shots, chr(10),
    '  metric: acc', chr(10), '  higher_is_better: ', higher, chr(10), '  dataset: ', dataset, chr(10),
    case when odd = 3 then concat('  scorer: x', chr(10)) else '' end, 'hypothesis: |', chr(10), '  ', about, chr(10),
    'evidence: none known', chr(10), 'suggested_training:', chr(10), '  steps: ', steps, chr(10), '  batch_size: ', batch, chr(10),
    'contamination: "', about, '"', chr(10), case when odd = 1 then concat('notes: x', chr(10)) else '' end) end as text
from (select id, odd, folder, name, 'Each file of this tree has one oddity at most.' as about,
  case when id % 17 = 0 then concat(name, '.yml') when id % 9 = 0 then concat('.', name, '.yaml') when id % 9 = 1 then concat('_', name, '.yaml')
       else concat(name, '.yaml') end as file,
  case odd when 8 then '12345' when 9 then 'null' else '"Expert on trees"' end as title,
  case odd when 4 then concat('{"github": "', lower(folder), '", "mail": "x"}') when 21 then '["a"]' else concat('{"github": "', lower(folder), '"}') end as proposer,
  case odd when 5 then '"1.0"' when 6 then '"heavy"' when 7 then '[1]' else '1.0' end as weight,
  case odd when 10 then '"2048"' when 11 then '2048.5' else '2048' end as seq,
  case odd when 12 then '"five"' when 13 then '99999999999' else '5' end as shots,
  case odd when 14 then '"maybe"' when 15 then '"yes"' when 16 then '2' else 'true' end as higher,
  case odd when 17 then '99999999999' when 18 then '123456789012345678901234' when 19 then '-99999999999' else '2000' end as steps,
  case odd when 27 then 'true' else '512' end as batch, case odd when 26 then '7' else '"lm_eval"' end as harness,
  case odd when 20 then '"org/exam"' else '{"path": "org/exam", "split": "test"}' end as dataset
from (select c_custkey as id, c_custkey % 28 as odd, concat('exp_t', cast(c_custkey as string)) as name,
  concat(case when c_custkey % 31 = 0 then '.' when c_custkey % 29 = 0 then '_' else '' end, 'User', cast(c_custkey % 40 as string)) as folder
  from customer) a) b
""",
    "fx_store": """
select doc_id, text, lang, source, n_chars, coalesce(source, 'src0') as dataset,
  case lang when 'de' then 'a' when 'fr' then 'r' else 'default' end as config,
  case when doc_id % 3 = 0 then 'validation' else 'train' end as split,
  case when doc_id % 4 = 3 then 'later' else repeat('0a', 20) end as added
from documents
""",
    "fx_pairs": """
select u.conv_id, u.turn, u.text as question, a.text as answer
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'
""",
}


# Which input tables each fixture reads.
FIXTURE_TABLES = {
    "fx_manifests": ("orders",),
    "fx_sources": ("lineitem",),
    "fx_benchmarks": ("orders",),
    "fx_catalog": ("part",),
    "fx_splits": ("part",),
    "fx_loads": ("part",),
    "fx_tasks": ("part",),
    "fx_changes": ("events",),
    "fx_prs": ("events", "customer"),
    "fx_tree": ("customer",),
    "fx_store": ("documents",),
    "fx_pairs": ("conversations",),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame. The input tables are bound to views of names
    of their own, dropped again once the text is analysed: the caller's views
    stay as they are, and the plan stays bound to `sf_dir`."""
    views = {t: f"corpusgate_{uuid.uuid4().hex}" for t in FIXTURE_TABLES[name]}
    text = FIXTURE_SQL[name]
    for t, view in views.items():
        table(spark, sf_dir, t).createOrReplaceTempView(view)
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {view}", text)
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [fixture(spark, sf_dir, n) for n in names]


def cte(*names: str) -> str:
    """`with fx_a as (...), fx_b as (...)` for oracle SQL."""
    return "with " + ",\n".join(f"{n} as ({FIXTURE_SQL[n].strip()})" for n in names)
