"""Export queries (task configuration) and the re-aimed mixture and
contamination operators, over the fixtures and the input tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusgate.operators import export as X
from corpusgate.operators.contamination import contamination, ngram_overlap
from corpusgate.operators.mixture import weighted_mixture
from corpusgate.plans.datacheck import valid_manifests
from corpusgate.plans.datacheck_sql import _VALID
from corpusgate.plans.manifests_sql import BASE as MANIFEST_BASE
from corpusgate.session import scratch_dir
from corpusgate.sources.sinks import write_configs
from corpusgate.sources.tables import table

GROUP_ID = 99
MIX_WEIGHTS = [("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1)]
MIX_SEED = "7"


def _valid_nested(spark, sf_dir):
    return valid_manifests(spark, sf_dir).select("manifest_id", "m")


def q_task_config(spark, sf_dir):
    """PR7 + PR8: one flat row per exported source of every accepted manifest."""
    m = _valid_nested(spark, sf_dir)
    cfg = X.task_config(F.col("m"), F.lit(GROUP_ID))
    return (m.select("manifest_id", cfg.alias("cfg"))
            .select("manifest_id", F.col("cfg.data.sequence_length").alias("sequence_length"),
                    F.posexplode("cfg.data.dataset_sources").alias("i", "s"))
            .select("manifest_id", (F.col("i") + 1).alias("pos"), "s.path", "s.name", "s.split", "s.weight",
                    "s.text_column", "s.text_template", "sequence_length"))


def q_revision_pins(spark, sf_dir):
    """PR9: the path → revision map, one row per entry."""
    m = _valid_nested(spark, sf_dir)
    return m.select("manifest_id", F.explode(X.revision_pins(F.col("m.data.dataset_sources"))).alias("path", "revision"))


def q_task_header(spark, sf_dir):
    """PR10 + PR11."""
    return _valid_nested(spark, sf_dir).select("manifest_id", X.header(F.col("m")).alias("header"))


def q_export_contract(spark, sf_dir):
    """SE4 (rows-only check): the keys every exported document writes are
    all declared ones."""
    docs = X.export_documents(_valid_nested(spark, sf_dir), F.lit(GROUP_ID))
    top = {"group_id", "data"}
    data = {"dataset_sources", "per_device_train_batch_size", "batch_size", "sequence_length",
            "eval_source_seeded_shard_pick", "eval_source_skip_max", "eval_source_revision_pin"}
    src = {"path", "name", "split", "weight", "text_column", "text_template"}
    j = F.col("config_json")
    src_keys = F.flatten(F.transform(F.from_json(F.get_json_object(j, "$.data.dataset_sources"),
                                                 "array<map<string,string>>"), lambda s: F.map_keys(s)))
    return docs.select(
        "manifest_id",
        F.size(F.array_except(F.json_object_keys(j), F.array(*map(F.lit, sorted(top))))).alias("extra_top"),
        F.size(F.array_except(F.json_object_keys(F.get_json_object(j, "$.data")),
                              F.array(*map(F.lit, sorted(data))))).alias("extra_data"),
        F.size(F.array_except(src_keys, F.array(*map(F.lit, sorted(src))))).alias("extra_source"))


def q_weighted_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = spark.createDataFrame(MIX_WEIGHTS, "source string, weight double")
    return weighted_mixture(docs, "lang", "doc_id", weights, seed=MIX_SEED).select(
        F.col("source").alias("lang"), F.col("row_id").alias("doc_id"))


def q_weighted_mixture_total(spark, sf_dir):
    """RA1 with a given total, three quarters of all rows: more than the weights alone can draw from some
    languages, so the others give more."""
    docs = table(spark, sf_dir, "documents")
    weights = spark.createDataFrame(MIX_WEIGHTS, "source string, weight double")
    total = docs.where(F.col("lang").isin([s for s, _ in MIX_WEIGHTS])).count() * 3 // 4
    return weighted_mixture(docs, "lang", "doc_id", weights, seed=MIX_SEED, total=total).select(
        F.col("source").alias("lang"), F.col("row_id").alias("doc_id"))


def q_contamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def q_ngram_contamination(spark, sf_dir):
    """RA3 by word n-grams: what each document shares with each benchmark item."""
    return ngram_overlap(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def q_written_configs(spark, sf_dir):
    """SC9: configuration documents written, and read back."""
    path = f"{scratch_dir(spark)}/configs-{uuid.uuid4().hex}"
    write_configs(X.export_documents(_valid_nested(spark, sf_dir), F.lit(GROUP_ID)), path)
    back = spark.read.schema("name string, document string, config string").json(f"{path}/configs")
    at = lambda p, kind: F.get_json_object("config", p).cast(kind)
    sources = F.from_json(F.get_json_object("config", "$.data.dataset_sources"),
                          "array<struct<path: string, name: string, split: string, weight: double, text_column: string, "
                          "text_template: string>>")
    line = lambda s: F.concat_ws("|", s["path"], F.coalesce(s["name"], F.lit("-")), s["split"],
                                 F.round(s["weight"] * 1e6).cast("bigint"), F.coalesce(s["text_column"], F.lit("-")),
                                 F.coalesce(s["text_template"], F.lit("-")))
    pins = F.from_json(F.get_json_object("config", "$.data.eval_source_revision_pin"), "map<string,string>")
    pin = F.array_join(F.array_sort(F.transform(F.map_entries(pins), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return back.select(
        "name", at("$.group_id", "int").alias("group_id"), at("$.data.sequence_length", "int").alias("sequence_length"),
        F.array_join(F.transform(sources, line), "\n").alias("sources"), F.coalesce(pin, F.lit("")).alias("pins"),
        F.concat_ws(",", *[at(f"$.data.{k}", "string") for k in ("per_device_train_batch_size", "batch_size",
                                                                  "eval_source_seeded_shard_pick", "eval_source_skip_max")])
        .alias("constants"),
        F.expr("substring(document, 1, length(document) - length(config) - 1)").alias("header"),
        F.col("document").endswith(F.concat("config", F.lit("\n"))).alias("whole"))


QUERIES = {
    "ngram_contamination": q_ngram_contamination,
    "written_configs": q_written_configs,
    "task_config": q_task_config,
    "revision_pins": q_revision_pins,
    "task_header": q_task_header,
    "export_contract": q_export_contract,
    "weighted_mixture": q_weighted_mixture,
    "weighted_mixture_total": q_weighted_mixture_total,
    "contamination": q_contamination,
}

_V = MANIFEST_BASE + _VALID

ORACLES = {
    "ngram_contamination": """
with i as (select item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as w from benchmark),
d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as w from documents),
ig as (select distinct item_id, array_to_string(w[k:k + 7], ' ') as g
       from (select *, unnest(range(1, len(w) - 6)) as k from i where len(w) >= 8) x),
dg as (select distinct doc_id, array_to_string(w[k:k + 7], ' ') as g
       from (select *, unnest(range(1, len(w) - 6)) as k from d where len(w) >= 8) x),
t as (select item_id, count(*) as total from ig group by item_id)
select item_id, doc_id, count(*) as shared, any_value(total) as total from ig join dg using (g) join t using (item_id)
group by item_id, doc_id""",
    "task_config": _V + """
select s.manifest_id, s.pos, s.path, case when coalesce(s.name, '') <> '' then s.name end as name, s.split, s.weight,
  case when coalesce(s.text_column, '') <> '' then s.text_column end as text_column,
  case when coalesce(s.text_column, '') = '' then s.text_template end as text_template, m.sequence_length
from fx_sources s join fx_manifests m using (manifest_id) where s.manifest_id in (select manifest_id from valid)""",
    "revision_pins": _V + """
select manifest_id, path, arg_max(revision, pos) as revision from fx_sources
where coalesce(revision, '') <> '' and manifest_id in (select manifest_id from valid) group by manifest_id, path""",
    "task_header": _V + """,
bl as (select manifest_id, string_agg('#   - ' || name || ': ' || harness
         || case when coalesce(task, '') <> '' then ' task ' || task || ', ' || coalesce(cast(num_fewshot as varchar), 'None')
                 || '-shot' else '' end
         || ', metric ' || metric || ' (' || case when higher_is_better then 'higher' else 'lower' end || ' is better)'
         || chr(10), '' order by pos) as lines
       from fx_benchmarks group by manifest_id)
select m.manifest_id, '# ' || m.name || ': ' || m.title || chr(10) || '# Exported from proposals/' || m.github || '/'
  || m.name || '.yaml,' || chr(10) || '# proposed by @' || m.github || '.' || chr(10) || '#' || chr(10)
  || '# STILL NEEDED before this can be scheduled: expert_assignment.json from' || chr(10)
  || '# profiling the base model on these sources, and an entry in' || chr(10)
  || '# configs/task_schedule.yaml. Check group_id is not already taken.' || chr(10) || '#' || chr(10)
  || '# Benchmarks the proposal will be judged on:' || chr(10) || coalesce(bl.lines, '')
  || case when m.steps is null and m.batch_size is null then ''
          else '# The proposer suggested: ' || concat_ws(', ',
                 case when coalesce(m.steps, 0) <> 0 then cast(m.steps as varchar) || ' steps' end,
                 case when coalesce(m.batch_size, 0) <> 0 then 'batch size ' || cast(m.batch_size as varchar) end)
               || ' (not applied).' || chr(10) end as header
from m left join bl using (manifest_id) where m.manifest_id in (select manifest_id from valid)""",
    "weighted_mixture": f"""
with w as (select * from (values {", ".join(f"('{s}', {w:.1f})" for s, w in MIX_WEIGHTS)}) t(source, weight)),
c as (select lang as source, count(*) as n from documents group by lang),
j as (select c.source, c.n, w.weight from c join w using (source)),
mn as (select min(floor(n / weight)) as mix_n from j),
b as (select j.*, mn.mix_n, cast(floor(weight * mix_n) as bigint) as base, weight * mix_n - floor(weight * mix_n) as rem
      from j, mn),
d as (select b.*, mix_n - sum(base) over () as deficit, row_number() over (order by rem desc, source) as rk from b),
q as (select source, base + case when rk <= deficit and base + 1 <= n then 1 else 0 end as quota from d),
r as (select lang, doc_id, row_number() over (partition by lang order by md5('{MIX_SEED}:' || cast(doc_id as varchar)), doc_id) as rn
      from documents)
select r.lang, r.doc_id from r join q on q.source = r.lang where r.rn <= q.quota""",
    "weighted_mixture_total": f"""
with recursive w as (select * from (values {", ".join(f"('{s}', {w:.1f})" for s, w in MIX_WEIGHTS)}) t(source, weight)),
c as (select lang as source, count(*) as n from documents group by lang),
j as (select c.source, c.n, w.weight from c join w using (source)),
tot as (select cast(sum(n) * 3 // 4 as bigint) as total from j),
-- pour by weight; who would overflow is filled, and the rest is poured again, until none overflows
pour as (select 0 as step, source, n, weight, false as done, cast(n as double) as share, tot.total as rest_n, 1e0 as rest_w from j, tot
  union all
  select step + 1, source, n, weight, done or over, case when done or over then cast(n as double) else want end,
    cast(total - sum(case when done or over then n else 0 end) over () as bigint),
    sum(case when done or over then 0 else weight end) over ()
  from (select p.*, tot.total, p.weight * p.rest_n / p.rest_w as want, not p.done and p.weight * p.rest_n / p.rest_w > p.n as over
        from pour p, tot where p.step < 8 and p.rest_w > 0) x),
last as (select * from pour where step = (select max(step) from pour)),
b as (select source, n, least(share, cast(n as double)) as share, floor(least(share, cast(n as double))) as base from last),
d as (select b.*, total - sum(base) over () as deficit,
        row_number() over (order by case when base < n then 0 else 1 end, share - base desc, source) as rk from b, tot),
q as (select source, cast(base + case when rk <= deficit and base < n then 1 else 0 end as bigint) as quota from d),
r as (select lang, doc_id, row_number() over (partition by lang order by md5('{MIX_SEED}:' || cast(doc_id as varchar)), doc_id) as rn
      from documents)
select r.lang, r.doc_id from r join q on q.source = r.lang where r.rn <= q.quota""",
    "export_contract": _V + """,
src as (select s.manifest_id, json_merge_patch('{}', json_object('path', s.path, 'split', s.split, 'weight', s.weight,
          'name', nullif(s.name, ''), 'text_column', nullif(s.text_column, ''),
          'text_template', case when coalesce(s.text_column, '') = '' then s.text_template end)) as j
        from fx_sources s where s.manifest_id in (select manifest_id from valid)),
pins as (select manifest_id, json_group_object(path, revision) as j from (
           select manifest_id, path, arg_max(revision, pos) as revision from fx_sources
           where coalesce(revision, '') <> '' group by manifest_id, path) p group by manifest_id),
doc as (select v.manifest_id, json_object('group_id', 99, 'data', json_merge_patch('{}', json_object(
          'dataset_sources', (select json_group_array(src.j) from src where src.manifest_id = v.manifest_id),
          'per_device_train_batch_size', 1, 'batch_size', 4, 'sequence_length', m.sequence_length,
          'eval_source_seeded_shard_pick', false, 'eval_source_skip_max', 1000000,
          'eval_source_revision_pin', pins.j))) as j
        from valid v join m using (manifest_id) left join pins using (manifest_id))
select manifest_id,
  cast(len(list_filter(json_keys(j), lambda k: not list_contains(['group_id', 'data'], k))) as integer) as extra_top,
  cast(len(list_filter(json_keys(j, '$.data'), lambda k: not list_contains(['dataset_sources', 'per_device_train_batch_size',
    'batch_size', 'sequence_length', 'eval_source_seeded_shard_pick', 'eval_source_skip_max', 'eval_source_revision_pin'], k)))
    as integer) as extra_data,
  cast(len(list_filter(flatten(list_transform(cast(json_extract(j, '$.data.dataset_sources') as json[]), lambda s: json_keys(s))),
    lambda k: not list_contains(['path', 'name', 'split', 'weight', 'text_column', 'text_template'], k))) as integer) as extra_source
from doc""",
    "contamination": """
select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)""",
}

_HEADER = ORACLES["task_header"][len(_V):]
ORACLES["written_configs"] = _V + _HEADER.replace("select m.manifest_id, '# '", ", hd as (select m.manifest_id, '# '", 1) + f""")
select m.name, {GROUP_ID} as group_id, m.sequence_length, sl.lines as sources, coalesce(pn.lines, '') as pins,
  '1,4,false,1000000' as constants, hd.header, true as whole
from m join hd using (manifest_id)
join (select manifest_id, string_agg(path || '|' || coalesce(nullif(name, ''), '-') || '|' || split || '|'
        || cast(cast(round(weight * 1e6) as bigint) as varchar) || '|' || coalesce(nullif(text_column, ''), '-') || '|'
        || case when coalesce(text_column, '') = '' then text_template else '-' end, chr(10) order by pos) as lines
      from fx_sources group by manifest_id) sl using (manifest_id)
left join (select manifest_id, string_agg(path || '=' || revision, ',' order by path || '=' || revision) as lines
      from (select manifest_id, path, arg_max(revision, pos) as revision from fx_sources
            where coalesce(revision, '') <> '' group by manifest_id, path) p group by manifest_id) pn using (manifest_id)
where m.manifest_id in (select manifest_id from valid)"""
