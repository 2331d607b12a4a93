"""Mixing sources to target weights: Efraimidis-Spirakis sampling under token budgets.

Sources by code point (null last) weigh 3, 1, 2, repeating, or as the caller says, and share a budget; a target stops
at `most` times its source's size and the excess is shared anew by weight until no target is above. A source whose
target is at least its size is taken whole that many times (complete epochs); what is left is selected: each document
has an exponential key, -ln(u) / weight, u from a hash of its id and text, and the documents of least keys are taken
until their sizes reach the budget. Heavier documents have smaller keys.

The prefix sum over a source's order is never made in one task: keys are 62-bit numbers in the order's sense, sizes
are summed by their leading bits (pre-aggregated), and only the bucket in which the budget runs out is opened again,
with more bits, until a bucket is small; just those last buckets are sorted. A last bucket of any size has rows of one
key, which are copies of one row: these are numbered by part, and sums over parts are a row each. So a source or a group
of copies with a third of all rows costs no more than others, and a rerun takes the same documents.

Whole documents are taken; the last is taken where that brings the sum nearer to the budget. Null and empty texts have
size 0 and are taken with their epochs; texts of any length are counted whole. Null source is a source of its own, null ids
are ids. Weights that are null or not over LEAST_WEIGHT count as that. Repeated rows count each; equal rows that straddle
the budget are told apart by a running number. An empty table gives none. Columns to carry may have any names but those of
the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import Scratch, numbered, text_or_empty, word_count

SEED = 20240229
BITS, KEY_BITS = 12, 62
LEAST_WEIGHT = 1e-12
#: A bucket with no more rows is sorted in one task.
SMALL = 50_000


def quality_weight(text: str | Column) -> Column:
    """Between 0.05 and 1: falls as symbols crowd out letters, and in very short texts."""
    t = text_or_empty(text)
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>!{}[]~^=_\\/", ""))
    clean = 1 - F.least(F.lit(1.0), 8.0 * symbols / F.greatest(F.length(t), F.lit(1)))
    return F.greatest(F.lit(0.05), clean * F.least(F.lit(1.0), F.length(t) / 200.0))


def sampling_key(row: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """Exponential key as a whole number of KEY_BITS bits: least first.

    The number is that of the key's logarithm, which keeps the order at all weights: keys lie between 2^-54 and
    54 / LEAST_WEIGHT, their logarithms between -38 and 32, and 2^55 steps to each 1 are finer than doubles there.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), row, F.coalesce(text, F.lit(""))), 11) + 0.5) / float(1 << 53)
    key = -F.log(u) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(LEAST_WEIGHT))
    return F.floor((F.log(key) + 64) * float(1 << (KEY_BITS - 7))).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, source_size, target) of (source, source_size), a row a source, ordered by a range sort."""
    scratch = Scratch(sizes.sparkSession)
    placed = numbered(sizes.orderBy(F.col("source").asc_nulls_last()), scratch, "ordered", "__at")
    weighed = placed.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod("__at", F.lit(len(weights))).cast("int"))).drop("__at")
    weighed = scratch.save(weighed, "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, full = share * total, []
    level = 0.0
    while True:
        # Sources whose weight at this level passes their bound are full; the rest share what those leave.
        is_full = F.lit(False) if not full else F.col("w") * full[-1] >= most * F.col("source_size")
        held, w = weighed.agg(F.sum(F.when(is_full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("w")))).first()
        new = (budget - (held or 0.0)) / w if w else float("inf")
        if new == level or not w:
            break
        level = new
        full.append(level)
    top = F.lit(most) * F.col("source_size")
    at = F.least(top, F.col("w") * level) if level != float("inf") else top
    return weighed.select("source", "source_size", F.greatest(at, F.lit(0.0)).cast("double").alias("target"))


def mix(df: DataFrame, text: str = "text", source: str = "source", row: str = "doc_id", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), weight: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the input (the row's id, source, `carry`) with size, source_size, target, times and taken (words)."""
    scratch = Scratch(df.sparkSession)
    key = sampling_key(F.col(row), F.col(text), weight if weight is not None else quality_weight(text))
    rows = df.select(F.col(row), F.col(source).alias("__s"), word_count(text).alias("size"), key.alias("__k"), *(c for c in carry if c not in (row, source)))
    rows = scratch.save(rows, "rows")
    sizes = rows.groupBy(F.col("__s").alias("source")).agg(F.sum("size").alias("source_size"))
    # A complete epoch each time that the target holds the source's size; left is what selection may take.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    plan = targets(sizes, share, most, weights).withColumn("epochs", whole)
    plan = plan.withColumn("left", F.when(F.col("source_size") > 0, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    plan = scratch.save(plan.select(F.col("source").alias("__p"), "source_size", "target", "epochs", "left", F.lit(0).cast("long").alias("low"), F.lit(KEY_BITS).alias("bits")), "plan0")
    step = 0
    here = F.col("__s").eqNullSafe(F.col("__p"))
    while True:
        # Inside each source's open bucket, sizes by the next bits; the bucket in which the budget ends is opened next.
        inside = rows.join(plan, here & F.expr("shiftright(__k, bits) = shiftright(low, bits)"))
        cells = inside.groupBy("__p", "left", "low", "bits", F.expr(f"shiftright(__k, greatest(bits - {BITS}, 0))").alias("cell")).agg(F.sum("size").alias("in_cell"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("in_cell").over(Window.partitionBy("__p").orderBy("cell"))
        ends = cells.withColumn("upto", upto).where("upto > left").groupBy("__p").agg(F.min_by(F.struct("cell", "upto", "in_cell", "n"), "cell").alias("e"))
        opened = plan.join(ends.withColumnRenamed("__p", "__e"), F.col("__p").eqNullSafe(F.col("__e")), "left")
        down = F.greatest(F.col("bits") - BITS, F.lit(0))
        none = F.col("e").isNull()
        new = opened.select(
            "__p", "source_size", "target", "epochs",
            F.when(none, F.col("left")).otherwise(F.col("left") - F.col("e.upto") + F.col("e.in_cell")).alias("left"),
            F.when(none, F.lit((1 << KEY_BITS) - 1)).otherwise(F.expr(f"shiftleft(e.cell, greatest(bits - {BITS}, 0))")).cast("long").alias("low"),
            F.when(none, F.lit(0)).otherwise(down).cast("int").alias("bits"),
            F.coalesce("e.n", F.lit(0)).cast("long").alias("n"), none.alias("all"),
        )
        step += 1
        saved = scratch.save(new, f"plan{step}")
        plan = saved.drop("n", "all")
        if (saved.where("bits > 0").agg(F.max("n")).first()[0] or 0) <= SMALL:
            break
    plan = saved.withColumnRenamed("n", "__n")
    placed = rows.join(plan, here).withColumn("__at", F.expr("shiftright(__k, bits)")).withColumn("__end", F.expr("shiftright(low, bits)"))
    before = placed.where("`all` or __at < __end").withColumn("once", F.when(F.col("left") > 0, 1).when(F.col("__at") < F.col("__end"), 1).otherwise(0))
    after = placed.where("not `all` and __at > __end").withColumn("once", F.lit(0))
    order = Window.partitionBy("__p").orderBy("__k", F.col(row), "size").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.when(F.col("__sum") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0)
    last = placed.where("not `all` and __at = __end")
    few = last.where("bits > 0").withColumn("__sum", F.sum("size").over(order)).withColumn("once", nearest).drop("__sum")
    # Rows of one key, so of one id and text: numbered within each part, after all of the parts before.
    alike = scratch.save(last.where("bits = 0").withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33)), "alike")
    parts = alike.groupBy("__p", "__part").agg(F.sum("size").alias("__in"))
    parts = parts.withColumn("__before", F.sum("__in").over(Window.partitionBy("__p").orderBy("__part")) - F.col("__in")).select(F.col("__p").alias("__q"), F.col("__part").alias("__r"), "__before")
    own = Window.partitionBy("__p", "__part").orderBy("__k", F.col(row), "size").rowsBetween(Window.unboundedPreceding, 0)
    alike = alike.join(parts, F.col("__p").eqNullSafe(F.col("__q")) & (F.col("__part") == F.col("__r")))
    alike = alike.withColumn("__sum", F.col("__before") + F.sum("size").over(own)).withColumn("once", nearest).drop("__sum", "__before", "__q", "__r", "__part")
    last = few.unionByName(alike)
    out = before.unionByName(after).unionByName(last)
    times = F.least(F.col("epochs") + F.col("once"), F.lit(int(most))).cast("long")
    out = out.withColumn("times", times)
    return out.select(row, F.col("__s").alias(source), *(c for c in carry if c not in (row, source)), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
