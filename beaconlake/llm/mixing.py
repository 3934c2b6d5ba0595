"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.base import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: The rank scale is cut into STEPS parts, the part that a source's budget ends in into STEPS slices, and
#: only the slice that it ends in is sorted exactly.
STEPS = 1024
#: Below this a copy count is whole.
TINY = 1e-9


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """unit: what a row's random number is drawn by, its id and text."""
    text = lambda c: F.coalesce(c, F.lit("null"))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
            F.concat(text(F.col(id_col).cast("string")), F.lit(":"), text(F.md5(F.col(text_col)))).alias("unit")]


def _level(size: Column) -> Column:
    """Binary digits of a size: a document's expected copies are in proportion to it."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def _rank(unit: Column, part: Column, seed: int) -> Column:
    """Random odds over inclusion odds. The random number is a hash of id and text: reruns agree."""
    word = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), unit)), 1, 13), 16, 10).cast("long")
    u = (word.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return (u / (1.0 - u)) * ((1.0 - part) / part)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): the words each source should give.

    Sources in code point order, null last, weigh ``weights``, repeating. They share the sum of all
    sizes; no target exceeds cap times its source's size, and what is above is shared again by
    weight. Sorted by the level at which a source fills up, this is one running sum. One row of two numbers for each
    source is all that meets in one task: 40 MB for a million sources.
    """
    every, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    filled = sizes.withColumn("weight", weight.cast("long")).withColumn("fill", (F.lit(cap) * F.col("source_size")).cast("double") / F.col("weight"))
    level = filled.withColumns({
        "full": F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.sum("weight").over(after),
        "total": F.sum("source_size").over(Window.partitionBy()),
    }).withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("left"))
    chosen = level.withColumn("water", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(Window.partitionBy()))
    target = F.least(F.col("water.level") * F.col("weight"), (F.lit(cap) * F.col("source_size")).cast("double"))
    return chosen.select("source", "source_size", target.alias("target"))


def fit_mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """What decides each document's copies, one row for each source and size level.

    ``sized`` has doc_id, source and size. Returns source, level, source_size, target, whole (certain
    copies), part (probability of one more), and the place in the ranking where the source's budget
    ends: documents of a slice below ``slice_at``, or in it and not after (rank_at, unit_at), are in. Rows
    equal in id and text share that last place; ``fit_n`` of the ``tied_n`` there are in.
    """
    levels = sized.where("size > 0").groupBy("source", _level(F.col("size")).alias("level")).agg(F.sum("size").alias("words"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    down = Window.partitionBy("source").orderBy(F.col("level").desc())
    below = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    solved = (
        levels.join(targets, levels.source.eqNullSafe(targets.source)).drop(targets.source)
        .withColumns({
            "capped": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum(F.col("level") * F.col("words")).over(below)})
        .withColumn("rate", (F.col("target") - F.lit(float(cap)) * F.col("capped")) / F.col("open"))
        .withColumn("fits", F.when(F.col("rate") * F.col("level") <= F.lit(cap + TINY), F.struct("level", "rate")))
        .withColumn("rate", F.max("fits").over(Window.partitionBy("source"))["rate"])
        .withColumn("copies", F.coalesce(F.least(F.col("rate") * F.col("level"), F.lit(float(cap))), F.lit(float(cap))))
        .withColumn("whole", F.floor(F.col("copies") + F.lit(TINY)))
        .withColumn("part", F.when(F.col("copies") - F.col("whole") > TINY, F.col("copies") - F.col("whole")).otherwise(0.0)))
    solved = solved.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")))
    plan = materialize(solved.select("source", "level", "source_size", "target", "whole", "part", "rest"), "mix-levels")

    ranked = _ranked(sized, plan, seed).where("part > 0").select("source", "slice", "rank", "unit", "size", "rest")
    ends = None
    for width in (STEPS, 1):
        rows = ranked if ends is None else ranked.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("slice") / STEPS) == F.col("at")))
        base = F.lit(0).cast("long") if ends is None else F.col("base")
        sums = rows.groupBy("source", "rest", base.alias("base"), F.floor(F.col("slice") / width).alias("at")).agg(F.sum("size").alias("words"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = (sums.withColumn("upto", upto).where("upto > rest").groupBy("source")
                .agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("base"))).alias("x"))
                .select(F.col("source").alias("s"), F.col("x.at").alias("at"), F.col("x.base").alias("base")))
    ends = ends.withColumnRenamed("at", "slice_at")
    inside = (ranked.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("slice_at")))
              .groupBy("source", "slice_at", "base", "rest", "rank", "unit", "size").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("rank", "unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = F.floor((F.col("rest") - F.col("base") - before) / F.col("size") + 0.5)  # a row is in if half of it is within the budget
    cuts = (inside.withColumn("fit", F.least(fit, F.col("n")))
            .withColumn("taken", F.when(F.col("fit") > 0, F.struct("rank", "unit", "fit", "n")))
            .groupBy(F.col("source").alias("s"), "slice_at").agg(F.max("taken").alias("last"))
            .select("s", "slice_at", F.col("last.rank").alias("rank_at"), F.col("last.unit").alias("unit_at"), F.col("last.fit").alias("fit_n"), F.col("last.n").alias("tied_n")))
    return materialize(plan.drop("rest").join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")


def _ranked(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds what the plan has for a document's source and level, its rank and its slice.

    The plan is a written table of at most 64 rows for each source: it is broadcast while that is small, and
    else AQE splits the hot source's rows of the shuffled join.
    """
    docs = sized.withColumn("level_", _level(F.col("size")))
    p = plan.withColumnRenamed("source", "source_")
    joined = docs.join(p, F.col("source").eqNullSafe(F.col("source_")) & (F.col("level_") == F.col("level")), "left")
    rank = F.when(F.col("part") > 0, _rank(F.col("unit"), F.col("part"), seed))
    return (joined.drop("source_", "level", "level_").withColumn("rank", rank)
            .withColumn("slice", F.floor(F.col("rank") / (1.0 + F.col("rank")) * STEPS * STEPS).cast("int")))


def _first_of_ties(tied: DataFrame) -> DataFrame:
    """Adds more: 1 for any fit_n of a source's tied rows, else 0. Rows are numbered where they lie: a running
    sum over the counts of the parts that they were written in, and row numbers in the one part that it ends in."""
    tied = materialize(tied.withColumn("tie_", F.monotonically_increasing_id()), "ties").withColumn("lies_", F.shiftright("tie_", 33))
    counts = tied.groupBy(F.col("source").alias("s_"), F.col("lies_").alias("l_")).agg(F.count("*").alias("here_"))
    upto = F.sum("here_").over(Window.partitionBy("s_").orderBy("l_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = tied.join(counts.withColumn("upto_", upto), F.col("source").eqNullSafe(F.col("s_")) & (F.col("lies_") == F.col("l_"))).withColumn("room_", F.col("fit_n") - F.col("upto_") + F.col("here_"))
    ends = (F.col("room_") > 0) & (F.col("room_") < F.col("here_"))
    number = F.row_number().over(Window.partitionBy("source", "lies_").orderBy("tie_"))
    more = placed.where(~ends).withColumn("more", (F.col("room_") > 0).cast("int")).unionByName(placed.where(ends).withColumn("more", (number <= F.col("room_")).cast("int")))
    return more.drop("tie_", "lies_", "s_", "l_", "here_", "upto_", "room_")


def apply_mix(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """Adds source_size, target, copies and taken to documents with doc_id, source, size and unit."""
    at, last = F.col("slice_at"), (F.col("rank") == F.col("rank_at")) & (F.col("unit") == F.col("unit_at"))
    more = F.when(at.isNull() | (F.col("slice") < at), 1).when((F.col("slice") == at) & ((F.col("rank") < F.col("rank_at")) | ((F.col("rank") == F.col("rank_at")) & (F.col("unit") <= F.col("unit_at")))), 1).otherwise(0)
    ranked, kept = _ranked(sized, plan, seed), sized.columns
    open_tie = F.coalesce(last & (F.col("fit_n") < F.col("tied_n")) & (F.col("part") > 0), F.lit(False))
    if plan.where("fit_n < tied_n").isEmpty():
        rows = ranked.withColumn("more", more)
    else:
        rows = ranked.where(~open_tie).withColumn("more", more).unionByName(_first_of_ties(ranked.where(open_tie)))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("part") > 0, F.col("more")).otherwise(0)
    return rows.select(*kept, "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every document.

    Expected copies within a source are in proportion to the number of binary digits of a document's
    size, up to ``cap``, and scaled so that they give the source's target. The whole part of them is
    certain. For the rest, documents are ranked by random odds over inclusion odds (Pareto order
    sampling) and taken in that order until the words of the target are reached: the sample's size is
    fixed to within half a document.

    Nulls: a null text has no words, a null source is a source, a null id is an id. A document
    without words gets no copies and taken 0; a source without words has target 0. A row's random number
    is drawn by its id and text; rows equal in both share it, and where the budget ends among them any of
    them are taken, as many as fit. An empty table gives an empty result. Other columns of docs are ignored,
    whatever their names. Very long texts are counted whole.
    """
    sized = materialize(docs.select(*_sized(docs, id_col, source_col, text_col)), "sizes")
    plan = fit_mix(sized, weights, cap, seed)
    per_source = plan.groupBy("source").agg(F.max("source_size").alias("ss"), F.max("target").alias("tt")).withColumnRenamed("source", "s_")
    out = apply_mix(sized, plan, seed)
    # documents without words have no level; their source's figures come from any of its levels
    return (out.join(per_source, F.col("source").eqNullSafe(F.col("s_")), "left")
            .withColumns({"source_size": F.coalesce("source_size", "ss", F.lit(0)).cast("long"), "target": F.coalesce("target", "tt", F.lit(0.0))})
            .drop("s_", "ss", "tt", "unit"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as it has copies, with the columns it came with.

    Sources, draws and ties are those of mix_sources: a null text or source counts as there, rows that share an id are units
    of their own, and rows equal in id and text are taken in any order, which no result tells. Texts without words have no
    copies. An empty table gives an empty result.
    """
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row_"), *_sized(docs, "doc_id", "source", "text"))
    sized = materialize(packed.select("doc_id", "source", "size", "unit"), "sizes")
    mixed = apply_mix(packed, fit_mix(sized, weights, cap, seed), seed)
    return mixed.where("copies > 0").select("row_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row_.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null') AS unit, row_number() OVER () AS row_, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
lv AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS level FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
f AS (SELECT *, (3 * source_size)::DOUBLE / weight AS fill FROM s),
g AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM f),
water AS (SELECT lvl FROM g WHERE fill >= lvl ORDER BY fill, lvl LIMIT 1),
t AS (SELECT source, source_size, least((SELECT lvl FROM water) * weight, (3 * source_size)::DOUBLE) AS target FROM g),
w AS (SELECT source, level, sum(size)::BIGINT AS words FROM lv WHERE size > 0 GROUP BY ALL),
c AS (SELECT w.*, t.target, (t.target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY w.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(level * words) OVER (PARTITION BY w.source ORDER BY level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
      FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
r AS (SELECT source, arg_max(rate, level) AS rate FROM c WHERE rate * level <= (3 + {TINY})::DOUBLE GROUP BY source),
m AS (SELECT c.source, c.level, c.words, c.target, coalesce(least(r.rate * c.level, 3.0::DOUBLE), 3.0::DOUBLE) AS copies FROM c LEFT JOIN r ON c.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, floor(copies + {TINY}::DOUBLE) AS whole, CASE WHEN copies - floor(copies + {TINY}::DOUBLE) > {TINY}::DOUBLE THEN copies - floor(copies + {TINY}::DOUBLE) ELSE 0 END AS part FROM m),
q AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS rest FROM p),
u AS (SELECT lv.*, q.whole, q.part, q.rest, (('0x' || substr(md5('17:' || unit), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM lv LEFT JOIN q ON lv.source IS NOT DISTINCT FROM q.source AND lv.level = q.level),
k AS (SELECT *, CASE WHEN part > 0 THEN (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - part) / part) END AS rank FROM u),
e AS (SELECT row_, 2 * coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, unit, row_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= 2 * rest AS taken FROM k WHERE part > 0)
SELECT k.doc_id, k.size, t.source_size, t.target,
       (k.size * (coalesce(k.whole, 0) + CASE WHEN e.taken THEN 1 ELSE 0 END))::BIGINT AS taken,
       (coalesce(k.whole, 0) + CASE WHEN e.taken THEN 1 ELSE 0 END)::BIGINT AS copies
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
LEFT JOIN e ON k.row_ = e.row_
"""
