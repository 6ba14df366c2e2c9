"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source gets a share of all words in proportion to its weight, clamped at ``max_epochs`` times what it has; the
excess goes to the others in proportion to their weights until no share is above its clamp. A source's documents are
then taken ``floor(target / size)`` whole times, and the documents first in a seeded order once more until the words
taken come as near the target as whole documents allow.

Scale: the order is cut in two steps. Words are summed per (source, first 16 bits of the hash), so that the running
sum sees at most 65,536 rows of a source however many documents it has; only the documents of the bucket that holds the
cut are then ordered. The documents themselves are never shuffled: they meet a table with one row per source, which
Spark broadcasts only if its measured size is below the session's threshold and joins with skew handling otherwise.
The rank of the sources is taken over a range partitioning, not in one task.

Edge cases: a null text has size 0 and an empty one too; they take 0 words. Null sources form one source, ranked last.
Rows with the same id and text have the same place in the order and are taken together. A source without words has
target 0. An empty table gives an empty result. Other columns of any name are ignored or passed through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the hash that make up a bucket of the running sum.
_DIGITS = 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); one row per source."""
    ranged = stored(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(
        ranged.join(before, "part").select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")),
        "weights",
    )
    total, free = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    used = n_clamped = 0
    while free:
        # Each round clamps every source whose share is above its cap; what is left grows, so the clamped set does too.
        share = F.col("weight") * F.lit(total - used).cast("long") / F.lit(free)
        clamped = share > F.col("cap")
        used, free, n = ranked.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
            F.count(F.when(clamped, 1)),
        ).first()
        if n == n_clamped:
            break
        n_clamped = n
    target = F.when(clamped, F.col("cap")).otherwise(share) if free else F.col("cap")
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def repetitions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(per-document table (doc_id, source, size, place), per-source plan with the cut of the seeded order)."""
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
            _place(F.col(id_col), F.col(text_col), seed).alias("place"),
        ),
        "sizes",
    )
    bucket = F.substring("place", 1, _DIGITS)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    sums = stored(by_bucket, "buckets")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "plan")

    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    reached = sums.withColumn("running", running).join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    cut = reached.where(F.col("running") >= F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("running") - F.col("words")).alias("before")), "bucket").alias("cut"))
    cut = plan.join(cut.select(F.col("source").alias("s"), "cut.bucket", "cut.before"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = sized.select(F.col("source").alias("s"), F.col("size"), F.col("place"), bucket.alias("b")).join(
        cut.select("source", "bucket", "before", "rest"), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bucket"))
    )
    same = inside.groupBy("source", "place", "before", "rest").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    words_here = F.col("size") * F.col("rows")
    start = F.col("before") + F.sum(words_here).over(Window.partitionBy("source").orderBy("place")) - words_here
    # A row is taken once more if its middle word is within the rest: the first ``more`` of equal rows.
    fit = F.floor((2 * (F.col("rest") - F.col("start")) + F.col("size")) / (2 * F.col("size")))
    more = F.least(F.greatest(fit, F.lit(0)), F.col("rows")).cast("long")
    taken = same.withColumn("start", start).where("size > 0").withColumn("more", more).where("more > 0")
    last = taken.groupBy("source").agg(F.max(F.struct("place", "more", "rows")).alias("last"))
    cut = cut.join(last.select(F.col("source").alias("s"), "last"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    split = F.coalesce(F.col("last.more") < F.col("last.rows"), F.lit(False))
    return sized, stored(cut.select("source", "source_size", "weight", "target", "whole", "bucket", F.col("last.place").alias("last"), F.col("last.more").alias("more"), split.alias("split"), F.lit(max_epochs).alias("most")), "cuts")


def _times(place: Column, some: Column, plan: str = "p") -> Column:
    """How often the mix takes a document: whole times, and once more before the cut if it has words."""
    b = F.substring(place, 1, _DIGITS)
    more = (b < F.col(f"{plan}.bucket")) | ((b == F.col(f"{plan}.bucket")) & (place <= F.col(f"{plan}.last")))
    return F.least(F.col(f"{plan}.whole") + F.coalesce(more & some, F.lit(False)).cast("long"), F.col(f"{plan}.most"))


def _numbered(rows: DataFrame, source: str, times: str, plan: DataFrame) -> DataFrame:
    """The rows at the cuts that split equal rows, ``times`` less one for those beyond the number that is taken once more."""
    mark = uuid.uuid4().hex
    part, at, before, s, more = (f"{x}_{mark}" for x in ("part", "at", "before", "s", "more"))
    here = stored(rows.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "split")
    counts = here.groupBy(source, part).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select(F.col(source).alias(s), F.col(part).alias(f"q_{mark}"), (F.sum("n").over(Window.partitionBy(source).orderBy(part)) - F.col("n")).alias(before))
    met = here.join(ahead, F.col(source).eqNullSafe(F.col(s)) & (F.col(part) == F.col(f"q_{mark}"))).drop(s, f"q_{mark}")
    met = met.join(plan.select(F.col("source").alias(s), F.col("more").alias(more)), F.col(source).eqNullSafe(F.col(s)))
    number = F.col(before) + F.row_number().over(Window.partitionBy(source, part).orderBy(at))
    return met.withColumn(times, F.col(times) - (number > F.col(more)).cast("long")).select(*[F.col(f"`{c}`") for c in rows.columns])


def _with_times(rows: DataFrame, plan: DataFrame, place: Column, some: Column, source: str, times: str) -> DataFrame:
    """``rows`` with ``times``, how often the mix takes each; ``some``: it has words."""
    mark = uuid.uuid4().hex
    at, split, full = f"place_{mark}", f"split_{mark}", f"full_{mark}"
    joined = rows.withColumns({at: place, full: some}).alias("d").join(plan.alias("p"), F.col(f"d.{source}").eqNullSafe(F.col("p.source")))
    here = F.col("p.split") & (F.col(f"d.{at}") == F.col("p.last"))
    # Whole times that are at their most already are the same for all equal rows.
    here = here & (F.col("p.whole") < F.col("p.most"))
    joined = joined.select(*[F.col(f"d.`{c}`") for c in rows.columns], _times(F.col(f"d.{at}"), F.col(f"d.{full}")).alias(times), F.coalesce(here, F.lit(False)).alias(split))
    if not plan.where("split AND whole < most").limit(1).count():
        return joined.drop(split)
    return joined.where(~F.col(split)).drop(split).union(_numbered(joined.where(split).drop(split), source, times, plan))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, repetitions, taken."""
    sized, plan = repetitions(docs, **options)
    each = _with_times(sized, plan, F.col("place"), F.col("size") > 0, "source", "repetitions").alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return each.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.weight", "p.target", "d.repetitions", (F.col("d.repetitions") * F.col("d.size")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns and in no order."""
    _, plan = repetitions(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    mark = uuid.uuid4().hex
    times, copy, source = f"times_{mark}", f"copy_{mark}", f"source_{mark}"
    rows = docs.withColumn(source, F.col(f"`{source_col}`"))
    rows = _with_times(rows, plan, _place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed), words(F.col(f"`{text_col}`")) > 0, source, times)
    repeated = rows.where(F.col(times) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
                  md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS place FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, source_size * {MAX_EPOCHS} AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
 o AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
              CAST(coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
              CAST(sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free FROM r),
 c AS (SELECT *, CAST(w * (total - used) AS DOUBLE) / free > cap AS clamped FROM o),
 z AS (SELECT coalesce(sum(cap) FILTER (clamped), 0) AS used, coalesce(sum(w) FILTER (NOT clamped), 0) AS free, any_value(total) AS total FROM c),
 t AS (SELECT c.source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(CAST(w * (z.total - z.used) AS BIGINT) AS DOUBLE) / CAST(z.free AS DOUBLE) END AS target, w FROM c, z),
 p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
 n AS (SELECT *, row_number() OVER (PARTITION BY source, place) AS number FROM d),
 m AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, number ROWS UNBOUNDED PRECEDING) AS DOUBLE) - CAST(size AS DOUBLE) / 2 AS middle FROM n),
 e AS (SELECT m.doc_id, m.source, m.size, p.source_size, CAST(p.w AS BIGINT) AS weight, p.target, least(p.whole + CAST(m.size > 0 AND m.middle <= greatest(p.target - p.whole * p.source_size, 0) AS BIGINT), {MAX_EPOCHS}) AS repetitions
       FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, weight, target, repetitions, repetitions * size AS taken FROM e
"""
