"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's documents are shuffled by a keyed hash and cut into blocks. A source of weight w has block j released at
slot floor(j / w), due by slot ceil((j + 1) / w). Slot after slot, the released block with the earliest deadline is taken.
As the weights add up to one this meets every window, so at any slot t each source has had between w t - 1 and w t + 1
blocks: it is never a whole block off its target while it has blocks left.

Weights are whole numbers of slots in a period, after which all windows start anew: the schedule of one period is worked out
once, in one row whose size is that of the set of sources and not of the data, and every block finds its slot by arithmetic.
Given targets are taken as the exact fractions they are written as (0.7, 0.2 and 0.1 are 7, 2 and 1 of 10 slots), so the bound
holds for them over any number of periods. Only if their common denominator exceeds ``LONGEST`` slots (and ten for each source) are
they rounded to that period. Without targets a source's weight is its size to ``POWER``, in slots of a period of about ``PERIOD``, or ten for each
source if that is more; every source gets at least one. When a source has no blocks left its slots stay
empty: all rows are kept, and the others keep their order and their proportions.

The running number of a document inside its source comes from 4096 hash buckets: a window counts inside (source, bucket),
a small table of bucket sizes gives the rows before, so that no source, however large, has to pass through one task.

Edge cases: a null source is a source of its own; null and empty texts are mixed like others; repeated rows get places
of their own; sources not named in the targets get what the smallest target has; an empty table gives an empty table;
further columns are kept (those named like the results are replaced).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, written

BLOCK = 16
PERIOD = 1000
LONGEST = 20_000
POWER = 0.7
SEED = "mix-1"


def _whole(targets: dict[str, float]) -> dict[str, int]:
    """Targets as the smallest whole numbers in the same proportions."""
    exact = {k: Fraction(str(v)) for k, v in targets.items()}
    if min(exact.values()) <= 0:
        raise ValueError("a target weight must be positive")
    unit = math.lcm(*(v.denominator for v in exact.values()))
    whole = {k: int(v * unit) for k, v in exact.items()}
    return {k: v // math.gcd(*whole.values()) for k, v in whole.items()}


def quotas(docs: DataFrame, targets: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """(name, i, quota): each source's slots in a period, which is the sum of all quotas."""
    sizes = docs.groupBy(_name().alias("name")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, least = F.sum("w").over(whole), F.count("*").over(whole) * 10
    if targets:
        slots = _whole(targets)
        known = F.create_map(*[F.lit(x) for k, v in slots.items() for x in (f"s{k}", v)])
        weighed = sizes.select("name", F.coalesce(F.try_element_at(known, F.col("name")), F.lit(min(slots.values()))).cast("long").alias("w"))
        longest = F.greatest(F.lit(LONGEST), least)
        quota = F.when(total <= longest, F.col("w")).otherwise(F.greatest(F.lit(1), F.round(F.col("w") / total * longest)))
    else:
        weighed = sizes.select("name", F.pow(F.col("n").cast("double"), F.lit(POWER)).alias("w"))
        quota = F.greatest(F.lit(1), F.round(F.round(F.col("w") / total * F.greatest(F.lit(period), least), 6)))
    return weighed.withColumn("quota", quota.cast("long")).select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("i"), "quota")


def pattern(quota: DataFrame) -> DataFrame:
    """(name, quota, k, slot, period): the slot of each source's k-th block in one period, earliest deadline first."""
    one = quota.agg(F.array_sort(F.collect_list(F.struct("i", "quota", "name"))).alias("s"), F.sum("quota").alias("period")).where("period > 0")
    return one.selectExpr(
        "s",
        "period",
        """aggregate(
             sequence(0L, period - 1),
             named_struct('given', transform(s, x -> 0L), 'taken', cast(array() as array<bigint>)),
             (state, t) -> element_at(transform(
               array(array_min(transform(s, (x, i) ->
                 if(state.given[i] < x.quota and (state.given[i] * period) div x.quota <= t,
                    (((state.given[i] + 1) * period + x.quota - 1) div x.quota) * 1000000 + i, null)))),
               key -> named_struct(
                 'given', transform(state.given, (g, i) -> if(i = key % 1000000, g + 1, g)),
                 'taken', concat(state.taken, array(key % 1000000)))), 1)
           ).taken AS taken""",
    ).selectExpr("s", "period", "posexplode(taken) AS (slot, source)").selectExpr("s[cast(source AS int)].name AS name", "s[cast(source AS int)].quota AS quota", "period", "slot", "row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k")


def _name() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def scheduled(docs: DataFrame, targets: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_slot (the slot of the document's block), mix_position (its place in the mix; places may be empty), mix_weight."""
    docs = docs.drop("mix_slot", "mix_position", "mix_weight")
    slots = broadcast_if_small(written(pattern(quotas(docs, targets, period)), "pattern"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    named = docs.withColumn("__name", _name()).withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    sizes = docs.select(_name().alias("__name"), F.substring(key, 1, 3).alias("__bucket")).groupBy("__name", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__name").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__name", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__name", "__bucket").orderBy("__key", "doc_id")
    numbered = named.withColumn("__row", F.row_number().over(inside) - 1).join(offsets, ["__name", "__bucket"])
    placed = numbered.withColumn("__j", F.col("__row") + F.col("__offset")).withColumn("__b", F.expr(f"__j div {block}"))
    ruled = slots.select(F.col("name").alias("__name"), F.col("quota").alias("__quota"), F.col("k").alias("__k"), F.col("slot").alias("__slot"), F.col("period").alias("__period"))
    sources = ruled.select("__name", "__quota", "__period").distinct()
    joined = placed.join(broadcast_if_small(sources), "__name").withColumn("__k", (F.col("__b") % F.col("__quota")).cast("int")).join(broadcast_if_small(ruled.select("__name", "__k", "__slot")), ["__name", "__k"])
    slot = F.expr("(__b div __quota) * __period + __slot")
    return joined.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block + F.col("__j") % block).withColumn("mix_weight", F.col("__quota") / F.col("__period")).select(*docs.columns, "mix_slot", "mix_position", "mix_weight")


def mixed(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` in the order of the mix."""
    return scheduled(docs, targets).orderBy("mix_position").select(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, source, mix_slot, mix_position, mix_weight of every document."""
    return scheduled(docs.select("doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE named AS (
    SELECT doc_id, source, coalesce('s' || source, 'n') AS name, md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS key FROM documents
), sizes AS (
    SELECT name, pow(CAST(count(*) AS DOUBLE), {POWER}) AS w FROM named GROUP BY name
), shares AS (
    SELECT name, w / sum(w) OVER () * greatest({PERIOD}, 10 * count(*) OVER ()) AS e FROM sizes
), quota AS (
    SELECT name, row_number() OVER (ORDER BY name) AS i, CAST(greatest(1, round(round(e, 6))) AS BIGINT) AS q FROM shares
), total AS (
    SELECT CAST(sum(q) AS BIGINT) AS period, list(CAST(q AS BIGINT) ORDER BY i) AS qs FROM quota
), sim AS (
    SELECT CAST(-1 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS given, CAST(0 AS BIGINT) AS picked FROM total
    UNION ALL
    SELECT t, list_transform(given, lambda g, i: CASE WHEN i = picked THEN g + 1 ELSE g END), picked
    FROM (
        SELECT t + 1 AS t, given,
               list_min(list_filter(list_transform(given, lambda g, i: CASE WHEN g < qs[i] AND (g * period) // qs[i] <= t + 1
                   THEN (((g + 1) * period + qs[i] - 1) // qs[i]) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS picked
        FROM sim, total WHERE t + 1 < period
    )
), slots AS (
    SELECT picked AS i, t AS slot, row_number() OVER (PARTITION BY picked ORDER BY t) - 1 AS k FROM sim WHERE t >= 0
), numbered AS (
    SELECT doc_id, source, name, row_number() OVER (PARTITION BY name ORDER BY key, doc_id) - 1 AS j FROM named
)
SELECT n.doc_id, n.source, CAST((n.j // {BLOCK}) // q.q * t.period + s.slot AS BIGINT) AS mix_slot,
       CAST(((n.j // {BLOCK}) // q.q * t.period + s.slot) * {BLOCK} + n.j % {BLOCK} AS BIGINT) AS mix_position,
       CAST(q.q AS DOUBLE) / t.period AS mix_weight
FROM numbered n JOIN quota q ON q.name = n.name CROSS JOIN total t JOIN slots s ON s.i = q.i AND s.k = (n.j // {BLOCK}) % q.q
"""
