"""Operator 8: mixing sources to target weights by Pareto order sampling.

Sizes are word counts. The sources, by code point with null last, weigh
`WEIGHTS` in turn and share all words; a source's target stops at `CAP` times
its size, and the excess is shared again by weight until none is above.

Inside a source every document first gets the certain whole copies,
floor(target / source size). What is left of the target is sampled without
replacement, a document once at most, with inclusion probabilities
lambda = min(1, kappa * sqrt(2 ^ class)), class being the binary order of its size;
kappa makes the expected words equal to what is left. Pareto order sampling
ranks the documents by (U / (1 - U)) / (lambda / (1 - lambda)), U being a fixed
hash of the id, and takes the smallest ranks until their words come nearest to
what is left. So every source meets its target to within half a document, and
reruns agree. In a table where an id stands on several rows, null included, U is a
hash of the id and the row's number in a staged copy, so such rows spread too.

The cut in a source's order is found without sorting the source: words are
summed per rank bucket before they are shuffled, a running sum over the
`BUCKETS` buckets finds the one that holds the cut, and only that bucket's
documents are ordered. The running sum over sources sees one row per source.

Cases: null and wordless texts have size 0 and are never taken; repeated rows and
rows with one id or none are drawn each for itself; null sources are
one source, last in order; a source of size 0 has target 0; an empty table
gives no row; extra columns pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import WORD, spare, staged, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BUCKETS = 1 << 16
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, row: Column | None = None, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 that depends on the id, and the row if given, alone (52 bits of an MD5)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    if row is not None:
        text = F.concat(text, F.lit(":"), row.cast("string"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): the weighted shares with stops, one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("stop_level", "place")
    by = F.array(*[F.lit(float(w)) for w in weights])
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("place", F.row_number().over(order))
            .withColumn("weight", F.element_at(by, (F.col("place") - 1) % len(weights) + 1))
            .withColumn("stop", F.lit(cap) * F.col("source_size"))
            .withColumn("stop_level", F.col("stop") / F.col("weight")))
    # sources in the order in which a rising common level would stop them
    before, here_on = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(everything))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0)))
                        / F.sum("weight").over(here_on))
            .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop_level"), F.struct(
                "stop_level", "place", "level"))).over(everything)["level"]))
    return rows.select("source", "source_size", F.least(
        F.col("stop").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))).alias("target"))


def _class_weight(size: Column) -> Column:
    """sqrt(2 ^ floor(log2(size)))."""
    return F.sqrt(F.pow(F.lit(2.0), F.length(F.bin(size)) - 1))


def plan(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """One row per source: whole copies, kappa and the last rank (p, id) that is taken once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    shares = (shares.withColumn("whole", whole)
              .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    filled = sizes.filter("size > 0")
    # tables of one row per source are written first: their size is then known, and Spark broadcasts
    # them only when they are small
    shares = staged(shares, "mix-shares")
    classes = (filled.groupBy("source", _class_weight(F.col("size")).alias("w"))
               .agg(F.sum("size").alias("class_words")))
    up = Window.partitionBy("source").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    kappa = (classes.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
             .select("source", "w", "source_size", "rest", F.sum("class_words").over(up).alias("below"),
                     F.sum(F.col("class_words") * F.col("w")).over(up).alias("weighted"))
             .withColumn("kappa", (F.col("rest") - (F.col("source_size") - F.col("below"))) / F.col("weighted"))
             .filter("kappa * w <= 1").groupBy("source").agg(F.max_by("kappa", "w").alias("kappa")))
    a, b = shares.alias("a"), kappa.alias("b")
    rules = staged(a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
        "a.*", F.greatest(F.coalesce("kappa", F.lit(0.0)), F.lit(0.0)).alias("kappa")), "mix-rules")
    # identical ranks are one row from here on
    ranked = (filled.join(rules.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
              .withColumn("p", rank(F.col("u"), F.col("size"), F.col("kappa"))))
    bucket = F.least(F.floor(F.col("p") * BUCKETS), F.lit(BUCKETS - 1))
    sums = (ranked.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_words"),
                                                                   F.first("rest").alias("rest")))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = staged(sums.withColumn("upto", F.sum("bucket_words").over(run)).filter("upto >= rest")
           .groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("bucket_words")).alias("before")),
                                           "bucket").alias("c"))
           .select(F.col("source").alias("s2"), "c.bucket", "c.before"), "mix-cut")
    edge = (ranked.withColumn("here", bucket)
            .join(cut, F.col("source").eqNullSafe(F.col("s2")) & (F.col("here") == F.col("bucket")))
            .groupBy("source", "p", "doc_id").agg(F.sum("size").alias("words"), F.first("before").alias("before"),
                                                  F.first("rest").alias("rest")))
    inside = Window.partitionBy("source").orderBy("p", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = (edge.withColumn("upto", F.col("before") + F.sum("words").over(inside))
             .filter("upto - words / 2 <= rest").groupBy("source").agg(F.max(F.struct("p", "doc_id")).alias("last")))
    a, b, c = rules.alias("a"), taken.alias("b"), cut.alias("c")
    # no document of the cut's bucket may fit: then the order ends before that bucket
    ended = F.when(F.col("c.bucket").isNotNull(),
                   F.struct((F.col("c.bucket") / F.lit(float(BUCKETS))).alias("p"), F.lit(None).cast("long").alias("doc_id")))
    return (a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left")
            .join(c, F.col("a.source").eqNullSafe(F.col("c.s2")), "left")
            .select("a.*", F.coalesce(F.col("b.last"), ended).alias("last")))


def rank(u: Column, size: Column, kappa: Column) -> Column:
    """The Pareto rank odds(U) / odds(lambda), carried to [0, 1) by x / (1 + x)."""
    chance = F.least(kappa * _class_weight(size), F.lit(1.0))
    top = u * (F.lit(1.0) - chance)
    return F.when(chance > 0, top / (top + chance * (F.lit(1.0) - u))).otherwise(F.lit(1.0))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, out: str = "mix") -> DataFrame:
    """`docs` with a struct column `out`: size, source_size, target, copies, taken."""
    out, row = spare(docs, out), spare(docs, "row_number")
    measured = lambda d, u: staged(d.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                                            words(F.col("text")).alias("size"), u.alias("u")), "sizes")
    u = uniform(F.col("doc_id"))
    sized = measured(docs, u)
    if not sized.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        u = uniform(F.col("doc_id"), F.col(row))
        sized = measured(docs, u)
    rules = staged(plan(sized, targets(sized, weights, cap)), "mix-plan")
    rules = rules.select(F.col("source").alias("__s"), F.struct(
        "source_size", "target", "whole", "rest", "kappa", "last").alias("__r"))
    r = F.col("__r")
    size = F.col("__size")
    p = rank(u, size, r["kappa"])
    more = (size > 0) & (r["rest"] > 0) & F.coalesce(
        F.struct(p.alias("p"), F.col("doc_id").cast("long").alias("doc_id")) <= r["last"], F.lit(False))
    copies = F.when(size > 0, r["whole"]).otherwise(0) + more.cast("long")
    return (docs.withColumn("__size", words(F.col("text")))
            .join(rules, F.col("source").eqNullSafe(F.col("__s")))
            .withColumn(out, F.struct(size.alias("size"), r["source_size"].alias("source_size"),
                                      r["target"].alias("target"), copies.alias("copies"),
                                      (copies * size).alias("taken")))
            .drop("__size", "__s", "__r", row))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`docs` with each row as often as the mix takes it."""
    out = spare(docs, "mix")
    found = mix(docs, weights, cap, out).filter(F.col(out)["copies"] > 0)
    return found.withColumn(out, F.explode(F.sequence(F.lit(1), F.col(out)["copies"].cast("int")))).drop(out)


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("mix")
    return found.select("doc_id", *[m[c].alias(c) for c in ("size", "source_size", "target", "taken")])
