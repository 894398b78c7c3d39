"""Change-log queries over the derived `fx_changes` fixture."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusgate.operators import changes as CH
from corpusgate.session import scratch_dir
from corpusgate.sources.fixtures import cte, fixture
from corpusgate.functions.joins import sized
from corpusgate.sources.sinks import append_batch, read_batches, write_reports

# The trusted list as a workflow would pass it.
TRUSTED = " user7,\nUser13 "
TRUSTED_SQL = "('user7', 'user13')"


def q_pr_violations(spark, sf_dir):
    return CH.pr_violations(fixture(spark, sf_dir, "fx_changes"), TRUSTED, sized(fixture(spark, sf_dir, "fx_prs"), "prs"))


def q_pr_reports(spark, sf_dir):
    changes, prs = fixture(spark, sf_dir, "fx_changes"), sized(fixture(spark, sf_dir, "fx_prs"), "prs")
    return CH.pr_reports(changes, CH.pr_violations(changes, TRUSTED, prs), TRUSTED, prs=prs)


def q_layout_problems(spark, sf_dir):
    """FI11 over every file path the change log names."""
    ch = fixture(spark, sf_dir, "fx_changes")
    files = ch.select(F.col("path")).unionByName(ch.select(F.col("old_path").alias("path"))).where(
        F.col("path").isNotNull())
    return CH.layout_problems(files)


def q_change_log_parse(spark, sf_dir):
    """SC7: the change log rendered as name-status lines, then parsed back."""
    ch = fixture(spark, sf_dir, "fx_changes")
    lines = ch.select("pr_id", "seq", F.when(F.col("old_path").isNotNull(),
                                             F.concat_ws("\t", F.concat(F.col("status"), F.lit("100")),
                                                         F.col("old_path"), F.col("path")))
                      .otherwise(F.concat_ws("\t", F.col("status"), F.col("path"))).alias("value"))
    return CH.parse_name_status(lines, keep=["pr_id", "seq"])


def q_written_reports(spark, sf_dir):
    """SC8: pull-request reports written, more appended, and read back."""
    path = f"{scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    reports = q_pr_reports(spark, sf_dir)
    write_reports(reports.where("violations > 0"), path, "pr_id")
    write_reports(reports.where("violations = 0"), path, "pr_id", mode="append")
    return spark.read.schema("pr_id string, markdown string").json(path)


def q_appended_reports(spark, sf_dir):
    """SC8: pull-request reports appended in three batches, each of them twice, beside a batch that broke off
    before its commit record; what readers see."""
    path = f"{scratch_dir(spark)}/batches-{uuid.uuid4().hex}"
    reports = sized(q_pr_reports(spark, sf_dir).select("pr_id", "markdown"), "reports")
    for _ in range(2):
        for k in range(3):
            append_batch(reports.where(F.col("pr_id") % 3 == k), path, f"b{k}")
    reports.write.json(f"{path}/data/batch=broken")
    return read_batches(spark, path, "pr_id bigint, markdown string")


QUERIES = {
    "written_reports": q_written_reports,
    "appended_reports": q_appended_reports,
    "pr_violations": q_pr_violations,
    "pr_reports": q_pr_reports,
    "layout_problems": q_layout_problems,
    "change_log_parse": q_change_log_parse,
}

PARTS = ("(case when starts_with({p}, '/') then list_concat(['/'], list_filter(string_split({p}, '/'), "
         "lambda x: x <> '' and x <> '.')) else list_filter(string_split({p}, '/'), "
         "lambda x: x <> '' and x <> '.') end)")


def _own(p: str, author: str) -> str:
    parts = PARTS.format(p=p)
    return f"""(case
  when len({parts}) <> 3 or {parts}[1] <> 'proposals' then '`' || {p} || '` is outside proposals/<your-login>/ — only `proposals/' || {author} || '/<task-name>.yaml` may change'
  when lower({parts}[2]) <> lower({author}) then '`' || {p} || '` is in `' || {parts}[2] || '`''s folder — you may only add files under `proposals/' || {author} || '/`'
  when not ends_with({parts}[3], '.yaml') or starts_with({parts}[3], '.') then '`' || {p} || '` is not a `.yaml` file — a submission is a single `<task-name>.yaml` and nothing else'
end)"""


_VIOL = cte("fx_changes", "fx_prs") + f""",
ch as (select * replace (coalesce(association, '') as association), (upper(coalesce(association, '')) in ('OWNER', 'MEMBER', 'COLLABORATOR') or lower(author) in {TRUSTED_SQL}) as maint
       from fx_changes),
p as (select pr_id, seq, author, 0 as side, old_path as p from ch where not maint and coalesce(old_path, '') <> ''
      union all select pr_id, seq, author, 1, path from ch where not maint and coalesce(path, '') <> ''),
why as (select pr_id, seq, side, {_own("p", "author")} as message from p),
sub as (select pr_id, seq, path from ch where not maint and substr(coalesce(status, ''), 1, 1) in ('A', 'M', 'R', 'C', 'T', '')
        and {_own("path", "author")} is null),
viol as (
  select pr_id, 0 as kind, cast(min(seq * 2 + side) // 2 as integer) as first_seq,
         cast(min(seq * 2 + side) % 2 as integer) as first_side, message
  from why where message is not null group by pr_id, message
  union all
  select pr_id, 1, cast(null as integer), cast(null as integer),
    'this pull request adds or edits ' || cast(count(*) as varchar) || ' proposals (' || string_agg(path, ', ' order by seq)
    || '); open one pull request per proposal so each collects its own votes'
  from sub group by pr_id having count(*) > 1
  union all
  select distinct pr_id, 0, cast(null as integer), cast(null as integer), 'this pull request changes no files'
  from fx_prs where pr_id not in (select pr_id from fx_changes)
    and not (upper(coalesce(association, '')) in ('OWNER', 'MEMBER', 'COLLABORATOR') or lower(author) in {TRUSTED_SQL}))"""

ORACLES = {
    "pr_violations": _VIOL + "\nselect * from viol",
    "pr_reports": _VIOL + f""",
prs as (select distinct pr_id, author, coalesce(association, '') as association,
          (upper(coalesce(association, '')) in ('OWNER', 'MEMBER', 'COLLABORATOR') or lower(author) in {TRUSTED_SQL}) as maint,
          lower(author) in {TRUSTED_SQL} as on_list from fx_prs),
v as (select pr_id, count(*) as n, string_agg('- ' || message, chr(10) order by kind, first_seq, first_side) as lines
      from viol group by pr_id)
select pr_id, author, cast(case when maint then 0 else coalesce(n, 0) end as integer) as violations,
  '### Submission rules' || chr(10) || chr(10) || case
    when maint then '✅ @' || author || ' is a maintainer (association ' || association
      || case when on_list then ', on the trusted list' else '' end || '); the file rules do not apply.' || chr(10)
    when coalesce(n, 0) = 0 then '✅ Only `proposals/' || author || '/` changed, and only a `.yaml` proposal.' || chr(10)
    else '❌ **This pull request changes files its author may not change.**' || chr(10) || chr(10) || lines
      || chr(10) || chr(10) || 'A submission is exactly one file, `proposals/' || author || '/<task-name>.yaml`.' || chr(10)
  end as markdown
from prs left join v using (pr_id)""",
    "layout_problems": cte("fx_changes") + f""",
f as (select path from fx_changes union all select old_path from fx_changes where old_path is not null),
x as (select {PARTS.format(p='path')} as parts from f),
r as (select parts[2:] as rel from x where parts[1] = 'proposals' and len(parts) > 1)
select distinct 'proposals/' || array_to_string(rel, '/') as file,
  'proposals/' || array_to_string(rel, '/') || ': only <github-login>/<task-name>.yaml files belong here' as problem
from r where len(list_filter(rel, lambda q: starts_with(q, '.'))) = 0
  and (len(rel) <> 2 or coalesce(regexp_extract(rel[len(rel)], '^.+(\\.[^.]+)$', 1), '') <> '.yaml')""",
    "change_log_parse": cte("fx_changes") + """
select pr_id, seq, status, path, old_path from fx_changes""",
}

ORACLES["appended_reports"] = f"select pr_id, markdown, 'b' || (pr_id % 3) as batch from ({ORACLES['pr_reports']}) r"
ORACLES["written_reports"] = f"select cast(pr_id as varchar) as pr_id, markdown from ({ORACLES['pr_reports']}) r"
