"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its share of tokens to an exponent, normalised. The exponent is the least (flattest mixture) that
keeps the mixture's entropy at or below a target and the most repeated source within a limit of passes; it is found by
multisection: each pass evaluates 33 exponents over the sources in one aggregation and keeps one interval of 32.

Weights are realised as block permutations under a token budget: a source's documents are dealt into blocks by a hash,
every pass over the source takes the blocks in an order of its own, and the last, partial pass ends where the budget does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.llm.storage import documents, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Entropy as a share of that of equal weights; passes over the most repeated source; the largest exponent tried.
TARGET_ENTROPY, MAX_PASSES, MAX_EXPONENT = 0.9, 2.0, 2.0
#: Tokens of a block at least. Blocks grow with the corpus so that there are about ``MOST_BLOCKS`` at most.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 100_000
#: Sources up to which the plan is broadcast (a few hundred bytes each); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
SEED = 2024


def source_sizes(table: DataFrame, source_col: str, text_col: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return table.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src")).agg(F.count("*").alias("docs"), F.sum(words).alias("tokens"))


def _measure(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, spread) for each: spread is the largest ratio of passes between two sources."""
    grid = sources.where("tokens > 0").select(F.log(F.col("tokens") / F.col("total")).alias("lp"), F.explode(F.array(*map(F.lit, exponents))).alias("e"))
    z = F.sum(F.exp(F.col("e") * F.col("lp")))
    mean = F.sum(F.exp(F.col("e") * F.col("lp")) * F.col("e") * F.col("lp"))
    ratio = (F.col("e") - 1) * F.col("lp")
    rows = grid.groupBy("e").agg((F.log(z) - mean / z).alias("entropy"), (F.max(ratio) - F.min(ratio)).alias("spread")).collect()
    return sorted((r["e"], r["entropy"], r["spread"]) for r in rows)


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, passes: int = 5) -> float:
    """The least exponent from 0 that meets both conditions, to about 1e-7; ``sources`` has tokens and total.

    Shares that are flatter than the target as they are stay as they are: the exponent is 1 at most. With fewer than two
    sources that have tokens it is 1.
    """
    n = sources.where("tokens > 0").count()
    if n < 2:
        return 1.0
    most, limit = target_entropy * math.log(n), math.log(max_passes)

    def least(good) -> float | None:
        lo, hi = 0.0, MAX_EXPONENT
        for _ in range(passes):
            grid = _measure(sources, [lo + (hi - lo) * i / 32 for i in range(33)])
            first = next((i for i, x in enumerate(grid) if good(x)), None)
            if first is None:
                return None
            if first == 0:
                return lo
            lo, hi = grid[first - 1][0], grid[first][0]
        return hi

    # past an exponent of 1 the spread grows again, towards sources that are large; only the flat side is searched for it
    by_spread = least(lambda x: x[0] >= 1 or x[2] <= limit)
    by_entropy = least(lambda x: x[1] <= most)
    return 1.0 if by_entropy is None else min(1.0, max(by_spread, by_entropy))


@dataclass
class Mixture:
    """``plan`` has a row for each source: weight, passes, blocks, and where its last pass ends."""

    plan: DataFrame
    exponent: float
    sources: int
    seed: int


def _block(source: Column, doc: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(source, doc, F.lit(seed)), blocks)


def _block_key(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(source, block, epoch, F.lit(seed + 1))


def _doc_key(doc: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(doc, epoch, F.lit(seed + 2))


def _with_plan(table: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """The plan's columns beside each row; the plan is small enough to broadcast if there are few sources."""
    return table.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, "src")


def plan_mixture(table: DataFrame, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, budget: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Mixture:
    """Weights and passes of all sources.

    ``budget`` is the mixture's tokens; by default the least at which every source is used in full at least once, so that
    no document is left out. Null and empty sources are one source. A source without tokens is passed over once.
    """
    base = materialise(source_sizes(table, source_col, text_col))
    total, n = base.agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    sources = base.withColumn("total", F.lit(total))
    a = exponent(sources, target_entropy, max_passes)
    power = F.pow(F.col("tokens") / F.col("total"), F.lit(a))
    z = sources.where("tokens > 0").agg(F.sum(power), F.max(F.col("tokens") / F.col("total") / power)).first()
    scale = (budget if budget is not None else total * (z[1] or 1) * (z[0] or 1)) / (z[0] or 1)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(max(BLOCK_TOKENS, total // MOST_BLOCKS)))).cast("long")
    live = F.col("tokens") > 0
    plan = sources.select(
        "src", "tokens", blocks.alias("blocks"),
        F.when(live, power / F.lit(z[0] or 1.0)).otherwise(0.0).alias("weight"),
        # rounded, so that a source that is to be used in full exactly once is
        F.when(live, F.round(power * F.lit(float(scale)) / F.col("tokens"), 9)).otherwise(1.0).alias("passes"),
    )
    plan = materialise(plan.withColumn("whole", F.floor("passes")).withColumn("rest", (F.col("passes") - F.col("whole")) * F.col("tokens")))
    own = table.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.col(id_col).alias("id"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    epoch = F.col("whole") + 1
    dealt = _with_plan(own, plan.where("rest > 0"), n).withColumn("block", _block(F.col("src"), F.col("id"), F.col("blocks"), seed)).withColumn("block_key", _block_key(F.col("src"), F.col("block"), epoch, seed))
    sums = dealt.groupBy("src", "block_key", "rest").agg(F.sum("n_words").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1))
    ends = sums.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.col("rest")).groupBy("src").agg(F.max(F.struct("block_key", "before")).alias("e"))
    ends = materialise(ends.select("src", F.col("e.block_key").alias("last_block"), F.col("e.before").alias("before")))
    last = dealt.join(F.broadcast(ends) if n <= BROADCAST_SOURCES else ends, "src").where(F.col("block_key") == F.col("last_block")).withColumn("doc_key", _doc_key(F.col("id"), epoch, seed))
    inside = F.coalesce(F.sum("n_words").over(Window.partitionBy("src").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = last.withColumn("at", F.col("before") + inside).where(F.col("at") < F.col("rest")).groupBy("src").agg(F.max("doc_key").alias("last_doc"))
    done = materialise(plan.join(ends.drop("before"), "src", "left").join(cut, "src", "left"))
    return Mixture(done, a, n, seed)


def mix_sources(table: DataFrame, mixture: Mixture, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row of ``table`` once for each pass that takes it, with ``mix_weight``, ``mix_epoch``, ``mix_block`` and ``mix_key``.

    Ordered by (mix_epoch, mix_key), a source's rows are the block permutation. Rows that repeat an id are in the same block
    and taken by the same passes. Columns of these names, and ``src``, are replaced. No text is shuffled: what a row needs
    to know is in the plan.
    """
    seed, plan = mixture.seed, mixture.plan.select("src", "blocks", "weight", "whole", "last_block", "last_doc")
    kept = [c for c in table.columns if c not in ("src", "mix_weight", "mix_epoch", "mix_block", "mix_key")]
    at = table.select(*kept).withColumn("src", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    held = plan.select("src", F.struct(*[c for c in plan.columns if c != "src"]).alias("_mixplan"))
    at = _with_plan(at, held, mixture.sources)
    p, doc, src = (lambda name: F.col(f"_mixplan.{name}")), F.col(id_col), F.col("src")
    block = _block(src, doc, p("blocks"), seed)
    key = _block_key(src, block, p("whole") + 1, seed)
    taken = (key < p("last_block")) | ((key == p("last_block")) & (_doc_key(doc, p("whole") + 1, seed) <= p("last_doc")))
    epochs = p("whole") + F.when(taken, 1).otherwise(0)
    # a sequence up to 0 would count down
    at = at.withColumn("mix_epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(1).cast("long"), epochs)).otherwise(F.array().cast("array<long>"))))
    return at.select(*kept, p("weight").alias("mix_weight"), F.col("mix_epoch").cast("int").alias("mix_epoch"), block.alias("mix_block"), _block_key(src, block, F.col("mix_epoch"), seed).alias("mix_key"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once for each pass that the mixture makes over it."""
    table = documents(spark, sf_dir)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    return mix_sources(table.select("doc_id", "source", words), plan_mixture(table))
