"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Documents get rates that stay as close to 1 as they can, by the relative
entropy of tokens, while each source reaches its target of tokens and the
lengths of texts are spread over the mix as they are over the corpus. The
solution is exp(l[source] + m . z[size]), at most MOST, where z are two moments
of the logarithm of the size; l and m minimise the convex dual, by Newton's method.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, running, temporary_tables, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
NEWTON_STEPS = 50
#: Relative distance of each source's tokens from its target, and of the moments from theirs, that ends the steps; so does one of TOKENS.
CLOSE, TOKENS = 1e-7, 0.01
#: The price of the moments' multipliers: targets of sources are met, moments as far as that leaves it possible.
RIDGE = 0.05
#: Deviations from the mean beyond which lengths count alike.
REACH = 2.0
#: Sums are taken in units of 1 / GRAIN, as whole numbers: they are the same in any order, so reruns agree.
GRAIN = 4096.0
#: Rates are taken in millionths.
UNIT = 1_000_000
#: Rows of one source and size that are ranked together.
RANKED = 200


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) one row each -> also target.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size.
    Of sources by cap per weight, a first part is capped: one is if its cap is
    no more than its share of what those before it leave.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by_name = running(sizes, [F.col("source").isNull(), F.col("source")], {"turn": F.lit(1)}, "source-names")
    rows = by_name.select("source", "source_size", "turn", F.element_at(turn, ((F.col("turn") - 1) % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    total = rows.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    if total["all"] is None:
        return sizes.withColumn("target", F.lit(0.0))
    rows = rows.withColumn("per_weight", F.col("cap") / F.col("weight"))
    rows = running(rows, [F.col("per_weight"), F.col("turn")], {"caps": F.col("cap"), "weights": F.col("weight")}, "source-caps")
    share = F.col("weight") * (total["all"] - F.col("caps") + F.col("cap")) / (total["weight"] - F.col("weights") + F.col("weight"))
    rows = materialize(rows.select("source", "source_size", "weight", "cap", (F.col("cap") <= share).alias("capped")), "capped-sources")
    left = rows.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)).alias("caps"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weight")).first()
    open_ = F.col("weight") * (total["all"] - left["caps"]) / F.lit(left["weight"])
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(open_).alias("target"))


def _total(x: Column) -> Column:
    return F.sum(F.round(x * GRAIN).cast("long")) / GRAIN


def with_moments(groups: DataFrame) -> DataFrame:
    """(source, size, n) -> also w (tokens) and z1, z2: the logarithm of the size, in deviations from its mean and at most REACH, and its square; both with a mean of 0 over all tokens."""
    x = F.when(F.col("size") > 0, F.log("size")).otherwise(0.0)
    w = F.col("w")
    groups = groups.withColumns({"w": (F.col("n") * F.col("size")).cast("double"), "x": x})
    of = groups.agg(F.sum("w").alias("w"), _total(w * F.col("x")).alias("x"), _total(w * F.col("x") * F.col("x")).alias("xx")).first()
    total = of["w"] or 1.0
    mean = (of["x"] or 0.0) / total
    spread = math.sqrt(max(0.0, (of["xx"] or 0.0) / total - mean * mean))
    z = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), (F.col("x") - mean) / spread)) if spread > 1e-3 else F.lit(0.0)
    groups = groups.withColumn("z1", z)
    of = groups.agg(_total(w * F.col("z1")).alias("z1"), _total(w * F.col("z1") * F.col("z1")).alias("z2")).first()
    return groups.withColumn("z2", F.col("z1") * F.col("z1") - (of["z2"] or 0.0) / total).withColumn("z1", F.col("z1") - (of["z1"] or 0.0) / total).drop("x")


def tilted_rates(groups: DataFrame, targets: DataFrame, most: float = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source, size, n, w, z1, z2) and (source, source_size, target) -> groups with source_size, target and rate.

    Each step sums gradient and curvature of the dual over all groups of
    documents that share source and size, which have the same rate. Multipliers
    of sources stand in a table and are eliminated source by source (their
    curvature is diagonal), so the driver solves for the two of the moments only.
    Sources whose target is their cap, or that have no token, take no part.
    """
    fixed = (F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))) | (F.col("target") <= 0)
    at = F.when(fixed, 0.0).otherwise(F.log(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    state = targets.select(F.col("source").alias("s"), "source_size", "target", fixed.alias("fixed"), at.alias("l"))
    m1 = m2 = 0.0

    def rated(state: DataFrame) -> DataFrame:
        met = groups.join(state, groups.source.eqNullSafe(state.s)).drop("s")
        met = met.withColumn("eta", F.col("l") + m1 * F.col("z1") + m2 * F.col("z2"))
        return met.withColumn("rate", F.when(F.col("fixed") & (F.col("target") > 0), float(most)).when(F.col("fixed"), 0.0).otherwise(F.least(F.lit(float(most)), F.exp("eta"))))

    for _ in range(steps):
        r, z1, z2 = F.col("w") * F.col("rate"), F.col("z1"), F.col("z2")
        a = F.when(~F.col("fixed") & (F.col("eta") < math.log(most)), r).otherwise(0.0)
        sums = {"got": r, "g1": r * z1, "g2": r * z2, "h": a, "h1": a * z1, "h2": a * z2, "h11": a * z1 * z1, "h12": a * z1 * z2, "h22": a * z2 * z2}
        by_source = rated(state).groupBy(F.col("source").alias("s"), "source_size", "target", "fixed", "l").agg(*(_total(x).alias(k) for k, x in sums.items()))
        by_source = materialize(by_source.withColumn("off", F.when(F.col("fixed"), 0.0).otherwise(F.col("got") - F.col("target"))), "newton-sums")
        per = lambda x: F.when(F.col("h") > 0, x / F.col("h")).otherwise(0.0)
        h1, h2, off = F.col("h1"), F.col("h2"), F.col("off")
        t = by_source.agg(
            F.max(F.when(~F.col("fixed"), F.greatest(F.lit(0.0), F.abs("off") - TOKENS) / F.col("target"))).alias("worst"), F.sum("target").alias("all"),
            *(_total(x).alias(k) for k, x in {"g1": F.col("g1"), "g2": F.col("g2"), "h11": F.col("h11"), "h12": F.col("h12"), "h22": F.col("h22"), "s11": per(h1 * h1), "s12": per(h1 * h2), "s22": per(h2 * h2), "r1": per(h1 * off), "r2": per(h2 * off)}.items()),
        ).first()
        if t["worst"] is None:
            break
        ridge = RIDGE * t["all"]
        g1, g2 = t["g1"] + ridge * m1, t["g2"] + ridge * m2
        if t["worst"] < CLOSE and max(abs(g1), abs(g2)) < max(CLOSE * t["all"], 10 * TOKENS):
            break
        a11, a12, a22 = t["h11"] - t["s11"] + ridge, t["h12"] - t["s12"], t["h22"] - t["s22"] + ridge
        b1, b2, det = t["r1"] - g1, t["r2"] - g2, a11 * a22 - a12 * a12
        d1, d2 = (b1 * a22 - b2 * a12) / det, (b2 * a11 - b1 * a12) / det
        short = min(1.0, 0.5 / max(abs(d1), abs(d2), 1e-300))  # steps of the moments keep their direction, and sources follow them
        d1, d2 = d1 * short, d2 * short
        own = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), off / F.col("h")))
        move = F.when(F.col("fixed"), 0.0).when(F.col("h") > 0, -own - (h1 * d1 + h2 * d2) / F.col("h")).otherwise(F.when(off > 0, -0.5).otherwise(0.0))
        state = by_source.select("s", "source_size", "target", "fixed", (F.col("l") + move).alias("l"))
        m1, m2 = m1 + d1, m2 + d2
    return rated(state).drop("eta", "l", "fixed")


def _allotted(rated: DataFrame, most: int) -> DataFrame:
    """(source, size, n, source_size, target, rate) -> how many copies all n documents get (whole) and how many of them one more (more).

    Rates are rounded systematically along falling sizes, which leaves a source
    at most half its largest document from its target; documents of a smaller
    size, smallest first, make that up by one copy each.
    """
    per_source = Window.partitionBy("source")
    falling = per_source.orderBy(F.desc("size"))
    rising = per_source.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("n") * (F.col("units") - UNIT * F.col("whole"))
    half = UNIT // 2
    lacks = F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("more"))).over(per_source)
    free = F.when(F.col("size") == 0, 0).when(F.col("lacks") > 0, F.when(F.col("whole") < most, F.col("n") - F.col("more")).otherwise(0)).otherwise(F.col("more"))
    used = F.coalesce(F.sum(F.col("size") * F.col("free")).over(rising), F.lit(0))
    flips = F.when(F.col("free") == 0, 0).otherwise(F.least(F.col("free"), F.greatest(F.lit(0), F.floor((F.abs("lacks") - F.col("used")) / F.col("size")))))
    return (
        rated.withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
        .withColumn("whole", F.expr(f"units div {UNIT}"))
        .withColumn("upto", F.sum(part).over(falling))
        .withColumn("more", F.expr(f"(upto + {half}) div {UNIT}") - F.floor((F.col("upto") - part + half) / UNIT))
        .withColumn("lacks", lacks)
        .withColumn("free", free)
        .withColumn("used", used)
        .withColumn("more", F.col("more") + F.signum("lacks").cast("long") * flips)
        .select("source", "size", "n", "source_size", "target", "whole", "more")
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, text, source) -> doc_id, tx, source, size, source_size, target, copies, taken for every row.

    size counts words of the whole text, however long; a null or empty text has
    none. Documents of one source and size have one rate, so each is taken
    floor(rate) or one more times, at most ``most`` times; equal rows may differ
    in that. A null source is a source. Which documents are taken once more
    depends on hashes of doc_id and text only, and sums are of whole numbers, so
    reruns agree. No rows give no rows; other columns are not read. Per source
    only counts by size meet in one task; documents of one source and size are
    ranked in parts.
    """
    row = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tx"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    spark = docs.sparkSession
    sized = materialize(row.withColumn("h", F.xxhash64("doc_id", "tx")), "sizes")
    with temporary_tables(spark):
        groups = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-groups")
        targets = materialize(source_targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
        groups = materialize(with_moments(groups), "size-moments")
        allot = materialize(_allotted(tilted_rates(groups, targets, most), most), "allotted", outlives=True)
    right = allot.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "whole", "more")
    met = sized.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    met = met.withColumn("part", F.pmod("h", F.ceil(F.col("n") / RANKED).cast("long")))
    many = allot.where((F.col("n") > RANKED) & (F.col("more") > 0)).select(F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("n") / RANKED).cast("long").alias("parts"))
    part_sizes = (
        sized.join(many, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .groupBy("source", "size", F.pmod("h", F.col("parts")).alias("part")).agg(F.count("*").alias("in_part"))
    )
    before = F.sum("in_part").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("in_part")
    offsets = part_sizes.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), before.alias("before"))
    met = met.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")), "left").drop("s", "z", "p")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id")) + F.coalesce("before", F.lit(0))
    copies = (F.col("whole") + F.when(rank <= F.col("more"), 1).otherwise(0)).cast("long")
    return met.withColumn("copies", copies).select("doc_id", "tx", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def expand(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs as often as the mix takes them; documents without words stay once.

    Rows that share doc_id, text and source are interchangeable: one of them is
    repeated as often as all of them are taken.
    """
    with temporary_tables(docs.sparkSession):
        plan = mix(docs, weights, most).groupBy(F.col("doc_id").alias("d"), F.col("tx").alias("t"), F.col("source").alias("s")).agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias("copies"), F.count("*").alias("same"))
        plan = materialize(plan, "mix", outlives=True)
    rows = docs.select(F.struct("*").alias("r")).select("r", F.xxhash64(F.coalesce("r.text", F.lit(""))).alias("x"))
    out = rows.join(plan.where("copies > 0"), F.col("r.doc_id").eqNullSafe(F.col("d")) & (F.col("x") == F.col("t")) & F.col("r.source").cast("string").eqNullSafe(F.col("s")))
    if not plan.where("same > 1").isEmpty():
        out = out.dropDuplicates(["d", "t", "s"])
    return out.select("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("r.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "source_size", "target", "taken")


#: What of the result SQL can express: sizes and targets.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
k AS (SELECT *, cap <= weight * (total - before) / rest AS capped FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
             weight * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () END AS target FROM k)
SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
