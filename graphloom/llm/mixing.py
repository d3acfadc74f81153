"""Temperature mixing of sources (DataFrame functions only).

Source shares of tokens are raised to an exponent, which is bisected (SECTIONS
parts a round, all tried in one aggregation) until the mixture has the target
entropy: by default EVEN of the way from the entropy the sources have to that of
an even mixture.  An exponent below 1 flattens the shares, one above 1 sharpens
them.  The search goes no further than where some source would be repeated more
than MAX_REPEAT times as often as the least repeated one; if the target lies
beyond, the exponent is that of the limit, and ``Exponent.met`` says so.  The
normalised weights become token budgets: the least repeated source is read once,
every other source as often as its weight says.

A source's stream is made of epochs.  Its documents lie in blocks of about
BLOCK_ROWS, or in LEAST_BLOCKS if they are few, so that budgets are met closely
at every size; each epoch permutes the blocks by hash, and documents inside
them.  The last epoch takes whole blocks until the budget is met.  Where blocks
start is summed in two steps (within RUN blocks, then over runs), so that no
task sees all blocks of a large source.  ``mix_at``, the place in the stream
over the budget, orders all sources' documents into one evenly mixed stream.

Defined results: null texts count as one token, as do empty ones; a null source
counts as the empty one; repeated rows are each dealt; rows are dealt by id and
text, so that rows without an id spread too; ties in hashes are ordered by
document id; a very long text is one row of many tokens; an empty table gives an
empty result; other columns are kept by the stage, whatever their names, and
ignored by the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.store import aside, table, written

MAX_REPEAT = 2.0
#: How far the mixture goes from the sources' own entropy to that of an even mixture.
EVEN = 0.5
SECTIONS = 32
ROUNDS = 5
BLOCK_ROWS = 512
#: Blocks of a source at least (fewer only if it has fewer rows).
LEAST_BLOCKS = 64
#: Blocks whose starts one task sums.
RUN = 4096
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text"):
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))).cast("long")


@dataclass(frozen=True)
class Exponent:
    """``met``: "target", or "repetition limit" where that stops the search first, or "even" for sources of one size."""

    value: float
    met: str
    target: float


def bisect_exponent(sources: DataFrame, target_entropy: float | None = None, max_repeat: float = MAX_REPEAT, even: float = EVEN) -> Exponent:
    """The exponent whose mixture has the target entropy (a share of the highest possible one) within the repetition limit.

    ``sources`` has ``total`` tokens of each source, all positive.  Entropy falls as the exponent grows.
    """
    n, most, least, whole = sources.agg(F.count(F.lit(1)), F.max("total"), F.min("total"), F.sum("total")).first()
    if not n or most == least:
        return Exponent(1.0, "even", 1.0)
    share, highest = F.col("total") / F.lit(float(whole)), math.log(n)
    if target_entropy is None:
        own = sources.agg(-F.sum(share * F.log(share))).first()[0] / highest
        target_entropy = own + even * (1.0 - own)
    limit = target_entropy * highest
    reach = math.log(max_repeat) / math.log(most / least)
    low, high = max(0.0, 1.0 - reach), 1.0 + reach
    for step_no in range(ROUNDS):
        step = (high - low) / SECTIONS
        tried = sources.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS)))).withColumn("a", F.lit(low) + F.col("i") * F.lit(step))
        # relative to the largest source, so that no power leaves the range of doubles
        power = F.pow(F.col("total") / F.lit(float(most)), "a")
        raised = tried.groupBy("i").agg(F.sum(power).alias("z"), F.sum(F.when(power > 0, power * F.log(power)).otherwise(0.0)).alias("e"))
        # entropy of p = x/z is log z - sum(x log x)/z
        fits = raised.where(F.log("z") - F.col("e") / F.col("z") <= limit).agg(F.min("i")).first()[0]
        if step_no == 0 and (fits is None or fits == 0):
            end = high if fits is None else low
            return Exponent(end, "target" if end == 0.0 and target_entropy >= 1.0 else "repetition limit", target_entropy)
        fits = SECTIONS if fits is None else max(1, fits)
        low, high = low + (fits - 1) * step, low + fits * step
    return Exponent(high, "target", target_entropy)


def plan(rows: DataFrame, target_entropy: float | None = None, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Per source: tokens, times it is read, budget and blocks.

    ``rows`` has _source, _key (a hash) and _tokens.
    """
    sources = written(rows.groupBy("_source").agg(F.sum("_tokens").alias("total"), F.count(F.lit(1)).alias("n")), "mix-sources")
    exponent = bisect_exponent(sources, target_entropy, max_repeat).value
    most, least = sources.agg(F.max("total"), F.min("total")).first()
    once = float((most if exponent <= 1 else least) or 1)
    budgets = sources.withColumn("_times", F.pow(F.col("total") / F.lit(once), F.lit(exponent - 1.0))).withColumn("_budget", F.col("_times") * F.col("total"))
    return budgets.withColumn("_blocks", F.greatest(F.least(F.col("n"), F.lit(LEAST_BLOCKS)), F.expr(f"n div {BLOCK_ROWS}")).cast("long")).drop("n")


def _block(key: str = "_key"):
    return F.pmod(F.col(key), F.col("_blocks"))


def schedule(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """_source, _block, _epoch, _start of every block that an epoch takes."""
    sized = rows.join(budgets.select("_source", "_blocks"), "_source").groupBy("_source", _block().alias("_block")).agg(F.sum("_tokens").alias("_size"))
    each = sized.join(budgets.select("_source", "total", "_times", "_budget"), "_source")
    each = each.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_times") - 1e-9).cast("int") - 1)))
    # the order of blocks is that of a hash, whose leading part names the run
    each = each.withColumn("_hash", F.xxhash64(F.lit(SEED), "_source", "_epoch", "_block")).join(budgets.select("_source", F.expr(f"greatest(1, _blocks div {RUN})").alias("_runs")), "_source")
    each = each.withColumn("_run", F.expr("shiftright(_hash, 32) + 2147483648L") * F.col("_runs") / F.lit(float(1 << 32))).withColumn("_run", F.floor("_run"))
    runs = each.groupBy("_source", "_epoch", "_run").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source", "_epoch").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_source", "_epoch", "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    order = Window.partitionBy("_source", "_epoch", "_run").orderBy("_hash", "_block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_inside", F.coalesce(F.sum("_size").over(order), F.lit(0))).join(runs, ["_source", "_epoch", "_run"])
    each = each.withColumn("_start", F.col("_epoch") * F.col("total") + F.col("_base") + F.col("_inside"))
    return each.where(F.col("_start") < F.col("_budget") * (1 - 1e-12)).select("_source", "_block", "_epoch", "_start", "_budget")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_source", F.coalesce(F.col("source"), F.lit(""))).withColumn("_key", F.xxhash64(F.lit(SEED), "doc_id", "text")).withColumn("_tokens", tokens())


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(_keyed(docs).drop("text"), "mix-rows")
    budgets = written(plan(rows), "mix-budgets")
    taken = written(schedule(rows, budgets), "mix-blocks")
    dealt = rows.join(budgets.select("_source", "_blocks"), "_source").withColumn("_block", _block()).join(taken, ["_source", "_block"])
    inside = Window.partitionBy("_source", "_block", "_epoch").orderBy(F.xxhash64("_key", "_epoch"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))
    return dealt.select("doc_id", "source", F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), at.cast("long").alias("position"), (at / F.col("_budget")).alias("mix_at"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as its block is taken."""
    docs, back = aside(docs, "doc_id", "text", "source")
    rows = written(_keyed(docs).select("_source", "_key", "_tokens"), "mix-rows")
    budgets = written(plan(rows), "mix-budgets")
    taken = schedule(rows, budgets).groupBy("_source", "_block").agg(F.count(F.lit(1)).alias("_copies"))
    taken = taken.join(budgets.select("_source", "_blocks"), "_source")
    wide = _keyed(docs).drop("_tokens").join(budgets.select("_source", "_blocks"), "_source").withColumn("_block", _block())
    wide = wide.join(written(taken.select("_source", "_block", "_copies"), "mix-copies"), ["_source", "_block"])
    return wide.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*back)
