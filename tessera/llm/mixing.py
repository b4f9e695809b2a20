"""Mixing sources to target weights by entropy balancing.

A source's documents get rates min(cap, exp(lambda * size / mean)): of all rates up to the cap that
bring the source to its target they have the least relative entropy to one. lambda is the root of the
convex dual's gradient, found for all sources at once by Newton steps, each one aggregation over
counts of (source, size). Sums are of whole numbers, so that no order of rows or tasks changes a digit.
Rates become copies by one shift a source of fixed uniform numbers, and one step of it turned over to
come nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import written

CAP = 2
STEPS = 1 << 12  # of the shift, over an interval of length two: a source has so many rows at most when it is rounded
UNIT = 1 << 40  # rates are summed as whole multiples of its inverse
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """docs with mix_size: runs of characters other than ASCII white space, 0 for a null text."""
    return docs.withColumn("mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """(source, n, source_size, target) of sizes(source, mix_size).

    Weights go round the sources in code point order, null last. A target above CAP times its source
    stops there; what is over goes to the rest by weight, which is one water level: in order of size by
    weight, sources are full until the level that the rest would have lies below them. The windows run
    over one row a source.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("mix_size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.lit(float(CAP)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", rest / left).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    # the first source that is not full, in filling order, has the level of all that are not; later ones show less
    by = by.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    return by.select("source", "n", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _whole(x: Column) -> Column:
    """x as a whole number of units, for sums that no order changes."""
    return F.round(x * float(UNIT)).cast("decimal(24,0)")


def tilts(sizes: DataFrame, goals: DataFrame, tolerance: float = 1e-8, rounds: int = 80) -> DataFrame:
    """goals with mean and lam, the root of each source's dual gradient; lam is null where all documents stand at the cap."""
    counts = written(sizes.where("mix_size > 0").groupBy("source", "mix_size").agg(F.count("*").alias("c")), "size-counts")
    start = goals.withColumn("mean", F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9)))
    open_ = F.col("target") < CAP * F.col("source_size") * (1 - 1e-12)
    state = start.withColumn("lam", F.when(open_, F.lit(0.0))).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.col("mean") * F.log(F.lit(float(CAP))) * 1.001).withColumn("done", F.col("lam").isNull())
    state = written(state, "tilts")
    for _ in range(rounds):
        x = F.col("mix_size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        said = (F.col("c") * F.col("mix_size")).cast("decimal(20,0)")
        moved = counts.join(state.where("not done").select(F.col("source").alias("s"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s")))
        got = F.sum(said * _whole(F.least(F.lit(float(CAP)), tilt)))
        slope = F.sum(said * F.when(tilt < CAP, _whole(x * tilt)).otherwise(F.lit(0).cast("decimal(24,0)")))
        sums = moved.groupBy("s").agg((got.cast("double") / UNIT).alias("got"), (slope.cast("double") / UNIT).alias("slope"))
        g = F.col("got") - F.col("target")
        next_ = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        next_ = next_.withColumn("hi", F.when(g > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(g < 0, F.col("lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - g / F.col("slope")
        inside = F.coalesce((F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), F.lit(False))
        met = F.coalesce(F.abs(g) <= tolerance * F.col("target"), F.lit(True))
        next_ = next_.withColumn("done", F.col("done") | met)
        next_ = next_.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)))
        seen = Observation()
        state = written(next_.select(start.columns + ["lam", "lo", "hi", "done"]).observe(seen, F.count_if(~F.col("done")).alias("open")), "tilts")
        if not seen.get["open"]:
            break
    return state.select(*start.columns, "lam")


def _rate() -> Column:
    x = F.col("mix_size") / F.col("mean")
    return F.when(F.col("lam").isNull(), F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("lam") * x, F.lit(50.0)))))


def _crossing(copies: int) -> Column:
    """The step of the shift from which a document has so many copies."""
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.ceil((F.lit(float(copies)) - (F.col("rate") + u) + 1) * (STEPS / 2)).cast("long")


def _copies() -> Column:
    """Copies whose step is reached, but for those of the step that is turned over."""
    return sum((F.col("step") >= _crossing(k)).__ne__(F.coalesce(_crossing(k) == F.col("turned"), F.lit(False))).cast("int") for k in range(1, CAP + 1))


def recipe(sizes: DataFrame, **goals) -> DataFrame:
    """One row a source of sizes(doc_id, source, mix_size): target, mean, lam, the step that rounds best and one to turn over.

    The words taken rise with the step; each document adds its size at up to CAP steps, so one
    aggregation by (source, step) and its running sum over at most STEPS rows a source give them all.
    Of the steps one more is turned over, in or out, where that comes nearer to the target.
    """
    state = tilts(sizes, targets(sizes, **goals))
    rated = sizes.where("mix_size > 0").join(state.select(F.col("source").alias("s"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate())
    steps = F.array(*[F.least(F.greatest(_crossing(k), F.lit(0)), F.lit(STEPS + 1)) for k in range(1, CAP + 1)])
    adds = rated.select("source", "mix_size", F.explode(steps).alias("at")).groupBy("source", "at").agg(F.sum("mix_size").alias("adds"))
    adds = adds.union(state.select("source", F.lit(STEPS // 2).cast("long"), F.lit(0).cast("long"))).groupBy("source", "at").agg(F.sum("adds").alias("adds"))
    running = written(adds.withColumn("taken", F.sum("adds").over(Window.partitionBy("source").orderBy("at"))).where(F.col("at") <= STEPS), "steps")
    near = running.join(state.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    gap = F.abs(F.col("taken") - F.col("target"))
    best = near.groupBy("s", "target").agg(F.min(F.struct(gap.alias("gap"), F.abs(F.col("at") - STEPS // 2).alias("far"), F.col("at").alias("step"), "taken")).alias("best"))
    turns = running.select("source", "at", "adds").join(best, F.col("source").eqNullSafe(F.col("s"))).where((F.col("at") > 0) & (F.col("adds") > 0))
    after = F.abs(F.col("best.taken") + F.when(F.col("at") > F.col("best.step"), F.col("adds")).otherwise(-F.col("adds")) - F.col("target"))
    turned = turns.where(after < F.col("best.gap")).groupBy("s").agg(F.min_by("at", F.struct(after, F.abs(F.col("at") - F.col("best.step")), "at")).alias("turned"))
    chosen = best.select("s", F.col("best.step").alias("step")).join(turned.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    out = state.join(chosen, F.col("source").eqNullSafe(F.col("s")), "left").select(*state.columns, F.coalesce("step", F.lit(STEPS // 2)).alias("step"), "turned")
    return written(out, "recipe")


def mixed_in(docs: DataFrame, made: DataFrame) -> DataFrame:
    """docs(doc_id, source, mix_size, ...) with source_size, target, rate and copies from a recipe."""
    plan = made.select(F.col("source").alias("mix_source"), "source_size", "target", "mean", "lam", "step", "turned")
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("rate", _rate())
    return joined.withColumn("copies", _copies()).drop("mix_source", "mean", "lam", "step", "turned")


def mix(docs: DataFrame) -> DataFrame:
    """For each row of documents: doc_id, size, source_size, target, taken (copies times size), copies, rate.

    A null text has size 0 and takes nothing; null is a source of its own. Repeated rows count as often
    as they come and share their rounding. An empty table gives an empty table; other columns are ignored.
    """
    base = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "mix_size"), "sizes")
    out = mixed_in(base, recipe(base))
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mix_size")).cast("long").alias("taken"), "copies", "rate")


def resampled(docs: DataFrame) -> DataFrame:
    """docs with each row as often as its copies say, in the columns of docs, whatever their names.

    Rows of size 0 (null texts too) are kept as their rate says; null sources, repeated rows and empty
    tables are as in mix.
    """
    base = sized(docs.select(F.struct("*").alias("document"), "doc_id", "source", "text")).drop("text")
    sizes = written(base.select("doc_id", "source", "mix_size"), "sizes")
    out = mixed_in(base, recipe(sizes)).where("copies > 0")
    return out.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("document.*")
