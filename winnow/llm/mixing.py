"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they
are) and normalised. The exponent is bisected to the smallest that keeps the entropy of the weights at
or below its target and every source at or below the repetition limit.

The weights are then realised within a token budget. The documents of a source fall into blocks by a
hash; every pass over a source takes its blocks in another order, and a source's last pass ends where its
share of the budget is reached. ``position`` runs from 0 to 1 through each source's part, so ordering
by it gives a mixture in which every stretch has the target weights.

Windows run within blocks of bounded size and over the block totals of a source; a source with a
third of all documents is as many blocks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import stage

EVENNESS = 0.5
MAX_REPEATS = 4.0
BLOCK_DOCS = 2048
STEPS = 50
MANY_SOURCES = 100_000
_WORDS = r"[^\x20\x09-\x0D]+"


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    evenness: float = EVENNESS,
    max_repeats: float = MAX_REPEATS,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The rows of the mixture: the input's columns, n_tokens, weight, epoch and position.

    Tokens are words; null and empty texts have none. The target entropy lies ``evenness`` of the way
    from the entropy of the shares to that of equal weights; ``budget`` is in tokens, by default
    all there are, and at most ``max_repeats`` times that. A row is in an epoch if its source's tokens
    before it fall short of the source's part, so a part is exceeded by less than one document. A
    null source is a source; sources without tokens, and an input without any, give no rows. Repeated
    rows count each. Input columns named like a result column are replaced.
    """
    n_tokens = F.coalesce(F.regexp_count(text, F.lit(_WORDS)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.struct(*docs.drop("n_tokens", "weight", "epoch", "position").columns).alias("row"),
        F.col(source).alias("source"),
        _order(key, seed).alias("order"),
        n_tokens.alias("n_tokens"),
    )
    counted = stage(rows.drop("row"))
    parts = stage(source_parts(counted, evenness, max_repeats, budget))
    few = parts.count() <= MANY_SOURCES
    small = F.broadcast(parts) if few else parts
    blocks = _block_offsets(_dealt(counted, small), seed)
    return _placed(_dealt(rows, small), blocks).select("row.*", "n_tokens", "weight", "epoch", "position")


def source_parts(counted: DataFrame, evenness: float, max_repeats: float, budget: int | None) -> DataFrame:
    """``(part, tokens, weight, quota, blocks)`` per source with tokens."""
    sums = counted.groupBy(F.col("source").alias("part")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    one = sums.where("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("part", "tokens", "docs"))).alias("parts"))
    one = one.withColumn("total", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    one = one.withColumn("shares", F.transform("parts", lambda x: x["tokens"] / F.col("total")))
    asked = F.col("total").cast("double") if budget is None else F.lit(float(budget))
    one = one.withColumn("budget", F.least(asked, F.lit(float(max_repeats)) * F.col("total")))
    natural = -_sum(lambda x: x * F.log(x))
    target = natural + F.lit(float(evenness)) * (F.log(F.size("shares").cast("double")) - natural)
    one = one.withColumns({"target": target, "least": F.array_min("shares")})

    def meets(exponent: Column) -> Column:
        total = _sum(lambda x: F.pow(x, exponent))
        entropy = F.log(total) - exponent * _sum(lambda x: F.pow(x, exponent) * F.log(x)) / total
        repeats = F.pow("least", exponent - 1) / total * F.col("budget") / F.col("total")
        return (entropy <= F.col("target")) & (repeats <= F.lit(float(max_repeats)))

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        met = meets(middle)
        return F.struct(F.when(met, ends["low"]).otherwise(middle).alias("low"), F.when(met, middle).otherwise(ends["high"]).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    one = one.withColumn("exponent", F.round(ends["high"], 9))
    one = one.withColumn("norm", _sum(lambda x: F.pow(x, F.col("exponent"))))
    each = one.select("parts", "shares", "exponent", "norm", "budget", F.posexplode("parts").alias("i", "each"))
    weight = F.pow(F.get("shares", F.col("i")), F.col("exponent")) / F.col("norm")
    return each.select(
        F.col("each.part").alias("part"),
        F.col("each.tokens").alias("tokens"),
        F.round(weight, 9).alias("weight"),
        F.round(weight * F.col("budget")).cast("long").alias("quota"),
        F.ceil(F.col("each.docs") / BLOCK_DOCS).alias("blocks"),
    ).where("quota > 0")


def _sum(of) -> Column:
    return F.aggregate("shares", F.lit(0.0), lambda a, x: a + of(x))


def _order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with their source's part and the number of their block."""
    block = F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("blocks"))
    return rows.join(parts, rows["source"].eqNullSafe(parts["part"])).withColumn("block", block)


def _block_offsets(rows: DataFrame, seed: int) -> DataFrame:
    """``(part, block, epochs)``: for each block, its passes and the source's tokens before it in each."""
    sums = rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("size"), F.first("tokens").alias("tokens"), F.first("quota").alias("quota"))
    last = F.floor((F.col("quota") - 1) / F.col("tokens"))
    passes = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), "part", F.col("block").cast("string")))
    order = Window.partitionBy("part", "epoch").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    return (
        passes.withColumn("before", before)
        .where("before < quota")
        .groupBy(F.col("part").alias("__part"), F.col("block").alias("__block"))
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "before"))).alias("epochs"))
    )


def _placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row per document and pass in which it is within its source's part."""
    order = Window.partitionBy("part", "block").orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))
    same = inside["part"].eqNullSafe(blocks["__part"]) & (inside["block"] == blocks["__block"])
    return (
        inside.join(blocks, same)
        .withColumn("pass", F.explode("epochs"))
        .withColumn("before", F.col("pass.before") + F.col("inside"))
        .where("before < quota")
        .withColumns({"epoch": F.col("pass.epoch"), "position": F.round(F.col("before") / F.col("quota"), 9)})
    )
