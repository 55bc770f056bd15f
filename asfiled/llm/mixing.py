"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws ``u`` from a hash of its id and gets the exponential key ``-ln(u) / weight``;
in the order of their keys documents are a weighted sample of any length (Efraimidis and
Spirakis). A source's target buys whole passes over the source first. What is left of it goes to
documents in key order until their sizes reach it.

Keys are never sorted over a source. They fall into 4096 ranges whose sizes are summed; the range
in which the target is reached is split again the same way, and only documents that share both
ranges with the border, a few millionths of a source, are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import materialise
from .rows import SPACED_WORD

#: Weights of the sources, in the order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: Text marks that lower a document's weight, and what a tenth of a mark per word costs.
_MARKS = "#*$%&|<>!"
_RANGES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for a text without marks, falling to 1/8 at one mark per word and more."""
    marks = F.length(text) - F.length(F.translate(text, _MARKS, ""))
    per_word = F.least(F.lit(1.0), marks / F.greatest(size, F.lit(1)))
    return F.coalesce(1 / (1 + 7 * per_word), F.lit(1.0))


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    ``share`` of all words is dealt by weight; no source gets more than ``most`` times its size,
    and what it can't take goes to the others by weight. Sources fill up in the order of size per
    weight, so running sums find the ones that are full. There is one row per source here.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("_place", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*map(F.lit, weights)),
                        (F.col("_place") % len(weights) + 1).cast("int"))
    filling = W.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    levelled = (listed.withColumn("_weight", pick)
                .withColumn("_cap", most * F.col("source_size"))
                .withColumn("_level", (share * F.sum("source_size").over(whole)
                                       - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                            / F.sum("_weight").over(after))
                .withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight")))
    # Once one source in this order is not full, none after it is; they share one level.
    level = F.min(F.when(~F.col("_full"), F.struct("_place_in_line", "_level"))).over(whole)["_level"]
    return (levelled.withColumn("_place_in_line", F.row_number().over(filling))
            .withColumn("_open", level)
            .withColumn("target", F.when(F.col("_full"), F.col("_cap"))
                        .otherwise(F.col("_open") * F.col("_weight")))
            .select("source", "source_size", "target"))


def _crossed(rows: DataFrame, by: list[str], step: str) -> DataFrame:
    """Per group of ``by``: the range in which the running size passes ``_left``, and what the
    ranges before it hold. Ranges per group are at most 4096."""
    summed = rows.groupBy(*by, step).agg(F.sum("size").alias("_size"), F.max("_left").alias("_left"))
    line = W.partitionBy(*by).orderBy(step)
    running = summed.withColumn("_upto", F.sum("_size").over(line))
    return (running.filter("_upto > _left").groupBy(*by).agg(
        F.min(F.struct(step, (F.col("_upto") - F.col("_size")).alias("_before"))).alias("_at"))
        .select(*by, F.col(f"_at.{step}").alias("_border"), "_at._before"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS,
        most: float = 2.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text",
        source: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``, ``epochs``.

    ``size`` is the number of words; ``epochs`` says how often the mix holds the document and
    ``taken`` is ``size`` times that. ``weight`` is a positive column, by default
    :func:`quality_weight`. The word total of a source differs from its target by at most half
    the size of the document at the border. Runs agree, as keys come from ids, not from a
    generator.

    A null or empty text has size 0; null is a source like others and stands last. Rows with one
    id share their draw and are told apart by weight and size; rows equal in these are taken one
    after the other. Texts count whole. An empty table gives an empty one. Columns are only read,
    never renamed, so others may bear any name.
    """
    words = n_words(F.col(text))
    worth = quality_weight(F.col(text), words) if weight is None else weight
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / 2.0 ** 48
    # 1 - u^(1/w) orders like -ln(u)/w and lies between 0 and 1.
    drawn = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"),
        (1 - F.pow(uniform, 1 / worth)).alias("key"))
    drawn = materialise(drawn.selectExpr(
        "*", f"least(cast(floor(key * {_RANGES}) as int), {_RANGES - 1}) as coarse",
        f"cast(floor(key * {_RANGES * _RANGES}L) as bigint) as fine"), "drawn")

    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, share, weights, most).selectExpr(
        "source", "source_size", "target",
        "cast(if(source_size > 0, floor(target / source_size), 0) as int) as _whole"
    ).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
    wanted = materialise(wanted, "targets")

    def with_group(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = other.withColumnRenamed("source", "_source")
        return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")

    rows = with_group(drawn, wanted, "inner")
    first = _crossed(rows, ["source"], "coarse").withColumnRenamed("_border", "_coarse")
    first = materialise(first.withColumnRenamed("_before", "_held"), "borders")
    near = with_group(rows, first, "inner").filter("coarse = _coarse").withColumn(
        "_left", F.col("_left") - F.col("_held"))
    second = materialise(_crossed(near, ["source"], "fine").withColumnRenamed("_border", "_fine"),
                         "borders")

    placed = with_group(with_group(rows, first, "left"), second, "left").withColumn(
        "_side", F.expr("case when _coarse is null or coarse < _coarse then -1 "
                        "when coarse > _coarse then 1 when fine < _fine then -1 "
                        "when fine > _fine then 1 else 0 end"))
    line = (W.partitionBy("source").orderBy("key", "doc_id", "size")
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    border = (placed.filter("_side = 0").withColumn("_upto", F.sum("size").over(line))
              .withColumn("_more", F.expr(
                  "_held + _before + _upto - size / 2.0 <= _left")).drop("_upto"))
    sure = placed.filter("_side <> 0").withColumn("_more", F.col("_side") < 0)
    return sure.unionByName(border).select(
        F.col("doc_id").alias(doc_id), "size", "source_size", "target",
        (F.col("size") * (F.col("_whole") + F.col("_more").cast("int"))).alias("taken"),
        (F.col("_whole") + F.col("_more").cast("int")).alias("epochs"))
