"""Who may change what: rules over (pull request, author, changed path) rows.

One table of pull requests, one job; the expected messages are built here from
the rules, path by path.
"""
import pytest
from pyspark.sql import functions as F

from corpusgate.functions import joins
from corpusgate.operators.changes import layout_problems, parse_name_status, pr_reports, pr_violations

LOG = ("pr_id long, seq int, author string, association string, status string, path string, old_path string")
PRS = "pr_id long, author string, association string"
TRUSTED = "\n gate-keeper[bot],\nIngrid ,,"


def outside(path, author="nora"):
    return f"`{path}` is outside proposals/<your-login>/ — only `proposals/{author}/<task-name>.yaml` may change"


def foreign(path, folder, author="nora"):
    return f"`{path}` is in `{folder}`'s folder — you may only add files under `proposals/{author}/`"


def no_yaml(path):
    return f"`{path}` is not a `.yaml` file — a submission is a single `<task-name>.yaml` and nothing else"


def several(*paths):
    return (f"this pull request adds or edits {len(paths)} proposals ({', '.join(paths)}); "
            "open one pull request per proposal so each collects its own votes")


OWN, SECOND = "proposals/nora/exp_ferries.yaml", "proposals/nora/exp_locks.yaml"

#: case -> (author, association, [(status, path, old path or None)], messages in order)
PULLS = {
    "one own file": ("nora", "NONE", [("A", OWN, None)], []),
    "login in other letters": ("NORA", "NONE", [("M", OWN, None)], []),
    "slashes and dots that mean nothing": ("nora", "NONE", [("A", "proposals//./nora/exp_ferries.yaml", None)], []),
    "own file away": ("nora", "NONE", [("D", OWN, None), ("A", SECOND, None)], []),
    "own file renamed": ("nora", "NONE", [("R", SECOND, OWN)], []),
    "two own files": ("nora", "NONE", [("A", SECOND, None), ("T", OWN, None)], [several(SECOND, OWN)]),
    "no status counts as a change": ("nora", "NONE", [("", OWN, None), (None, SECOND, None)], [several(OWN, SECOND)]),
    "top of the tree": ("nora", "NONE", [("M", "LICENSE", None)], [outside("LICENSE")]),
    "no folder": ("nora", "NONE", [("A", "proposals/exp_ferries.yaml", None)], [outside("proposals/exp_ferries.yaml")]),
    "one folder too many": ("nora", "NONE", [("A", "proposals/nora/a/b.yaml", None)], [outside("proposals/nora/a/b.yaml")]),
    "absolute": ("nora", "NONE", [("A", "/proposals/nora/b.yaml", None)], [outside("/proposals/nora/b.yaml")]),
    "upwards": ("nora", "NONE", [("A", "proposals/nora/../b.yaml", None)], [outside("proposals/nora/../b.yaml")]),
    "a neighbour's file": ("nora", "NONE", [("D", "proposals/olav/b.yaml", None)], [foreign("proposals/olav/b.yaml", "olav")]),
    "taken from a neighbour": ("nora", "NONE", [("R", OWN, "proposals/olav/b.yaml")],
                               [foreign("proposals/olav/b.yaml", "olav")]),
    "other suffix": ("nora", "NONE", [("A", "proposals/nora/b.json", None)], [no_yaml("proposals/nora/b.json")]),
    "hidden file": ("nora", "NONE", [("A", "proposals/nora/.b.yaml", None)], [no_yaml("proposals/nora/.b.yaml")]),
    "each message once, as first seen": (
        "nora", "NONE", [("M", "z", None), ("C", "y", "x"), ("M", "z", None), ("A", OWN, None), ("M", SECOND, None)],
        [outside("z"), outside("x"), outside("y"), several(OWN, SECOND)]),
    "maintainer": ("nora", "Collaborator", [("D", "LICENSE", None)], []),
    "trusted": ("ingrid", "NONE", [("D", "LICENSE", None)], []),
    "trusted robot": ("Gate-Keeper[bot]", None, [("D", "LICENSE", None)], []),
    "no association": ("nora", None, [("M", "LICENSE", None)], [outside("LICENSE")]),
    "no author": (None, "NONE", [("M", "LICENSE", None)], [outside("LICENSE", "")]),
    "nothing changed": ("nora", "NONE", [], ["this pull request changes no files"]),
    "nothing changed by a maintainer": ("nora", "OWNER", [], []),
}


@pytest.fixture(scope="module")
def judged(spark):
    """case -> (messages in order, report)"""
    ids = {case: i for i, case in enumerate(PULLS)}
    log = spark.createDataFrame([(ids[c], n, author, role, *change) for c, (author, role, changes, _) in PULLS.items()
                                 for n, change in enumerate(changes)], LOG)
    prs = spark.createDataFrame([(ids[c], author, role) for c, (author, role, _, _) in PULLS.items()], PRS)
    found = pr_violations(log, TRUSTED, prs)
    rows = found.orderBy("pr_id", "kind", "first_seq", "first_side").collect()
    reports = {r.pr_id: r for r in pr_reports(log, found, TRUSTED, prs=prs).collect()}
    return {c: ([r.message for r in rows if r.pr_id == i], reports[i]) for c, i in ids.items()}


@pytest.mark.parametrize("case", PULLS)
def test_messages(judged, case):
    assert judged[case][0] == PULLS[case][3]


@pytest.mark.parametrize("case", PULLS)
def test_a_report_says_what_was_found(judged, case):
    messages, report = judged[case]
    assert report.violations == len(messages)
    assert [line[2:] for line in report.markdown.split("\n") if line.startswith("- ")] == messages
    free = case in ("maintainer", "trusted", "trusted robot", "nothing changed by a maintainer")
    assert ("is a maintainer" in report.markdown) == free
    assert ("❌" in report.markdown) == bool(messages)
    assert (", on the trusted list" in report.markdown) == case.startswith("trusted")


def test_name_status_lines(spark):
    lines = ["M\tdocs/index.md", "R087\ta/old name.yaml\tb/new name.yaml", "C100\tx\ty", "D\tgone", "A"]
    got = [tuple(r) for r in parse_name_status(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("M", "docs/index.md", None), ("R", "b/new name.yaml", "a/old name.yaml"), ("C", "y", "x"),
                   ("D", "gone", None), ("A", None, None)]


def test_layout_lists_what_does_not_belong(spark):
    belongs = ["nora/exp_ferries.yaml", "nora/.note", ".cache/x/y", "nora/.git/config"]
    stray = ["exp_ferries.yaml", "nora/notes.txt", "nora/deep/exp_ferries.yaml", "nora/yaml"]
    files = spark.createDataFrame([(f"proposals/{p}",) for p in belongs + stray] + [("elsewhere/a.txt",)], "path string")
    got = {r.file: r.problem for r in layout_problems(files).collect()}
    assert got == {f"proposals/{p}": f"proposals/{p}: only <github-login>/<task-name>.yaml files belong here" for p in stray}


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """What one task holds is bounded by the rows of a partition, whatever the session's number of partitions."""
    monkeypatch.setattr(joins, "PART_ROWS", 10)
    log = spark.createDataFrame([(i // 3, i % 3, "nora", "NONE", "A", f"f{i}", None) for i in range(300)], LOG)
    prs = spark.createDataFrame([(i, "nora", "NONE") for i in range(120)], PRS)
    found = pr_violations(log, TRUSTED, prs)
    reports = pr_reports(log, found, TRUSTED, prs=prs)
    assert reports.groupBy(F.spark_partition_id()).count().count() > 20
    assert found.groupBy(F.spark_partition_id()).count().count() > 40
    assert reports.where("violations = 3").count() == 100 and reports.where("violations = 1").count() == 20
