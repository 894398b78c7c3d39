"""Change-log rules: who may change what in a pull request (SC7, FI8–FI11,
AG9–AG10, SF7, RE2).

Input is a change log `changes(pr_id, seq, author, association, status,
path, old_path)`, one row per changed file, `seq` its order in the PR.

Plan: each change is exploded into its paths (old path first), each path
classified by Column expressions, and per PR the *distinct* messages are
kept with the position they were first seen — `groupBy(pr, message)` with
`min(seq, side)`. Rows are dealt over partitions by their number before they are
grouped, so a task holds equally many however long the log is. The result carries that order key instead of a dense
rank, so no window has to hold a whole pull request in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.joins import parts_of
from corpusgate.functions.ordered import joined, step
from corpusgate.functions.text import message, ustrip


def parse_trusted(value: Column) -> Column:
    """SF7: newline → comma, split, strip, lower, drop empties."""
    parts = F.split(F.regexp_replace(value, "\n", ","), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.lower(ustrip(t))), lambda t: t != ""))


def path_parts(path: Column) -> Column:
    """POSIX path parts as `PurePosixPath` gives them: empty and '.' parts
    dropped, a leading '/' kept as its own part, '..' kept."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def own_proposal_problem(path: Column, author: Column) -> Column:
    """FI8: why `path` is not one of `author`'s proposal files (null if it is)."""
    parts = path_parts(path)
    folder = F.get(parts, 1)
    file = F.get(parts, 2)
    return (
        F.when((F.size(parts) != 3) | (F.get(parts, 0) != K.PROPOSALS_FOLDER),
               message(K.MSG_OUTSIDE, path=path, author=author))
        .when(F.lower(folder) != F.lower(author), message(K.MSG_OTHER_FOLDER, path=path, folder=folder, author=author))
        .when(~file.endswith(K.PROPOSAL_SUFFIX) | file.startswith("."), message(K.MSG_NOT_YAML_FILE, path=path))
    )


def trusted_logins(trusted: str) -> Column:
    """The trusted list as given on the command line (comma / newline
    separated), parsed by SF7 into a constant array Catalyst folds."""
    return parse_trusted(F.lit(trusted))


def is_maintainer(author: Column, association: Column, trusted: str) -> Column:
    """FI9: a maintainer association, or a trusted login (ignoring case).
    Unknown (null) is neither: the rules then apply."""
    return F.coalesce(F.upper(association).isin(*K.MAINTAINER_ASSOCIATIONS), F.lit(False)) \
        | F.coalesce(F.array_contains(trusted_logins(trusted), F.lower(author)), F.lit(False))


def known(changes: DataFrame) -> DataFrame:
    """Null author, association and path as empty text, so that no message vanishes with them."""
    fill = [c for c in ("author", "association", "path") if c in changes.columns]
    return changes.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in fill})


def submits(status: Column, path: Column, author: Column) -> Column:
    """FI10: the change adds or edits one of the author's own proposals
    (status letter A/M/R/C/T — or none; D does not count)."""
    return F.substring(F.coalesce(status, F.lit("")), 1, 1).isin(*K.SUBMITTING_STATUSES) \
        & own_proposal_problem(path, author).isNull()


def pr_violations(changes: DataFrame, trusted: str, prs: DataFrame | None = None) -> DataFrame:
    """AG9 + AG10: per non-maintainer PR, the distinct path messages in the
    order first seen (old path before new within a change), then one
    message when more than one proposal is added or edited. `prs(pr_id,
    author, association)` also names PRs without any change: one fixed
    message each.

    Output: pr_id, kind (0 path, 1 count), first_seq, first_side, message.
    Sorting by (kind, first_seq, first_side) gives the report order."""
    parts = parts_of(changes) if prs is None else parts_of(changes, prs)
    changes = known(changes)
    bound = changes.where(~is_maintainer(F.col("author"), F.col("association"), trusted))
    paths = bound.select(
        "pr_id", "seq", "author",
        F.inline(F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("old_path").alias("p")),
                                  F.struct(F.lit(1).alias("side"), F.col("path").alias("p"))),
                          lambda x: F.coalesce(x["p"], F.lit("")) != "")))
    why = paths.select("pr_id", "seq", "side", own_proposal_problem(F.col("p"), F.col("author")).alias("message"))
    # first sighting as one bigint (seq * 2 + side): a fixed-width min, so the
    # aggregate stays a codegen HashAggregate
    per_path = (why.where(F.col("message").isNotNull())
                .select("pr_id", "message", (F.col("seq").cast("bigint") * 2 + F.col("side")).alias("first"))
                .repartition(parts, "pr_id", "message")
                .groupBy("pr_id", "message").agg(F.min("first").alias("first"))
                .select("pr_id", F.lit(0).alias("kind"), F.floor(F.col("first") / 2).cast("int").alias("first_seq"),
                        (F.col("first") % 2).cast("int").alias("first_side"), "message"))
    sub = bound.where(submits(F.col("status"), F.col("path"), F.col("author"))).select("pr_id", "seq", "path")
    many = (joined(sub, ["pr_id"], step("seq"), ["seq", "path"], "path", ", ", "paths", parts, "n")
            .where((F.col("n") > 1) & F.col("pr_id").isNotNull())
            .select("pr_id", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("first_seq"),
                    F.lit(None).cast("int").alias("first_side"),
                    message(K.MSG_MANY_PROPOSALS, n=F.col("n"), paths=F.col("paths")).alias("message")))
    found = per_path.unionByName(many)
    if prs is None:
        return found
    named = known(prs).select("pr_id", (~is_maintainer(F.col("author"), F.col("association"), trusted)).alias("bound"),
                              F.lit(False).alias("changes"))
    changed = changes.select("pr_id", F.lit(False).alias("bound"), F.lit(True).alias("changes"))
    bare = (named.unionByName(changed).repartition(parts, "pr_id")
            .groupBy("pr_id").agg(F.max("bound").alias("bound"), F.max("changes").alias("changes"))
            .where(F.col("bound") & (F.col("pr_id").isNull() | ~F.col("changes"))))
    return found.unionByName(bare.select(
        "pr_id", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("first_seq"),
        F.lit(None).cast("int").alias("first_side"), F.lit(K.MSG_NO_FILES).alias("message")))


def pr_reports(changes: DataFrame, violations: DataFrame, trusted: str, guide_hint: str = "",
               prs: DataFrame | None = None) -> DataFrame:
    """RE2: one Markdown report per PR (maintainer / clean / violations)."""
    parts = parts_of(changes) if prs is None else parts_of(changes, prs)
    # different rows first: a pull request of very many rows is then no long sort
    prs = (known(changes if prs is None else prs).select("pr_id", "author", "association").repartition(parts, "pr_id")
           .distinct().groupBy("pr_id").agg(F.min("author").alias("author"), F.min("association").alias("association")))
    lines = violations.withColumn("line", F.concat(F.lit("- "), F.col("message"))).withColumn(
        "at", F.when(F.col("kind") == 0, F.coalesce("first_seq", F.lit(0))))  # the count of proposals comes last
    per = joined(lines, ["pr_id"], step("at"), ["kind", "first_seq", "first_side", "message"], "line", "\n", "lines", parts, "n")
    found = prs.join(per, "pr_id", "left")
    author, assoc = F.col("author"), F.col("association")
    on_list = F.array_contains(trusted_logins(trusted), F.lower(author))
    head = F.lit(f"{K.SUBMISSION_TITLE}\n\n")
    note = F.when(on_list, F.lit(K.SUBMISSION_TRUSTED_NOTE)).otherwise(F.lit(""))
    maint = F.concat(head, message(K.SUBMISSION_MAINTAINER, author=author, association=assoc, trusted=note),
                     F.lit("\n"))
    clean = F.concat(head, message(K.SUBMISSION_CLEAN, author=author), F.lit("\n"))
    bad = F.concat(head, F.lit(K.SUBMISSION_BAD + "\n\n"),
                   F.col("lines"), F.lit("\n\n"), message(K.SUBMISSION_FOOTER, author=author, hint=guide_hint), F.lit("\n"))
    maintainer = is_maintainer(author, assoc, trusted)
    n = F.coalesce("n", F.lit(0))
    return found.select(
        "pr_id", "author",
        F.when(maintainer, F.lit(0)).otherwise(n).cast("int").alias("violations"),
        F.when(maintainer, maint).when(n == 0, clean).otherwise(bad).alias("markdown"))


def parse_name_status(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """SC7: `git diff --name-status` lines → (status, path, old_path).
    Status is the first letter; R and C carry `old<TAB>new`."""
    f = F.split(F.col(value), "\t")
    letter = F.substring(F.get(f, 0), 1, 1)
    renamed = letter.isin(*K.RENAME_STATUSES)
    return lines.select(
        *(keep or []), letter.alias("status"),
        F.when(renamed, F.get(f, 2)).otherwise(F.get(f, 1)).alias("path"),
        F.when(renamed, F.get(f, 1)).alias("old_path"))


def layout_problems(files: DataFrame, root: str = K.PROPOSALS_FOLDER, path: str = "path") -> DataFrame:
    """FI11: files under `root` that are not `<login>/<name>.yaml`. Files with
    any part starting with '.' are ignored. `files(path)` lists files (not
    directories) relative to the tree's parent."""
    parts = path_parts(F.col(path))
    rel = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(rel, -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    under = (F.get(parts, 0) == root) & (F.size(rel) > 0)
    visible = ~F.exists(rel, lambda p: p.startswith("."))
    bad = (F.size(rel) != 2) | (suffix != K.PROPOSAL_SUFFIX)
    return (files.where(under & visible & bad)
            .select(F.array_join(rel, "/").alias("rel")).distinct()
            .select(F.concat(F.lit(root + "/"), F.col("rel")).alias("file"),
                    message(K.MSG_LAYOUT, root=root, rel=F.col("rel")).alias("problem")))
