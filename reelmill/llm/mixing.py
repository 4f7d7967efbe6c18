"""Temperature mixing of sources.

Source shares p of the tokens become weights p^a / sum(p^a). The exponent is the largest one (nearest to the natural
shares) that meets a target entropy, kept at or above the smallest one under which no source is repeated more than a
limit. The weights are realised as whole documents: every source is laid out in seeded permutations, one an epoch, and
cut at its token budget; the position in the budget names the block, so that every block of the mixture holds each
source in the proportion of its weight, and blocks are permuted inside.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import stored, text_of

TARGET_ENTROPY = 0.95
REPETITION = 1.25
BLOCK_TOKENS = 1 << 20
GRID = 64
ROUNDS = 5
ROWS_PER_BUCKET = 1_000


def token_count(text_col: str = "text"):
    """Words of a text, at least one: the unit of the budgets."""
    return F.greatest(F.lit(1), F.regexp_count(text_of(text_col), F.lit(r"\S+"))).cast("long")


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, repetition: float = REPETITION) -> float:
    """The exponent in 0..1 for a stored table (source, tokens).

    Normalised entropy falls and the greatest repetition (max of w/p over its min, when the scarcest source is not
    cut) falls to 1 as the exponent grows to 1. A bisection over GRID points a round, each round one aggregation.
    """
    total = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total[0] or total[1] < 2:
        return 1.0
    p = F.col("tokens") / F.lit(float(total[0]))

    def measured(points: list[float]) -> list[tuple[float, float]]:
        """(normalised entropy, greatest epochs over least epochs) at each exponent."""
        sums = sources.agg(*[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(points)], *[F.sum(F.pow(p, F.lit(a)) * F.log(p) * F.lit(a)).alias(f"e{i}") for i, a in enumerate(points)], F.max(p).alias("hi"), F.min(p).alias("lo")).first()
        n = float(total[1])
        return [((math.log(sums[f"z{i}"]) - sums[f"e{i}"] / sums[f"z{i}"]) / math.log(n), (sums["hi"] / sums["lo"]) ** (1 - a)) for i, a in enumerate(points)]

    def bisect(ok) -> tuple[float, float]:
        """The last point (lo) at which a condition that holds from 0 up to an edge still holds, and the next one."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
            good = [ok(*m) for m in measured(points)]
            k = max([i for i, g in enumerate(good) if g], default=0)
            lo, hi = points[k], points[min(GRID, k + 1)]
            if lo == hi:
                break
        return lo, hi

    flat = bisect(lambda entropy, _: entropy >= target_entropy)[0]
    limit = bisect(lambda _, epochs: epochs > repetition)[1]
    return max(flat, limit)


def weights(sources: DataFrame, alpha: float) -> DataFrame:
    """source, tokens, weight, epochs: the budget lets the source with the fewest epochs pass exactly once."""
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(1))).first()[0]
    raw = sources.withColumn("raw", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha)))
    sums = raw.agg(F.coalesce(F.sum("raw"), F.lit(1.0)), F.coalesce(F.min(F.col("raw") / F.col("tokens")), F.lit(1.0))).first()
    return raw.select("source", "tokens", (F.col("raw") / F.lit(sums[0])).alias("weight"), (F.col("raw") / F.col("tokens") / F.lit(sums[1])).alias("epochs"))


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, repetition: float = REPETITION, block_tokens: int = BLOCK_TOKENS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, epoch, tokens, weight, alpha, block, slot_key: one row for each time a document is drawn.

    Every document is drawn at least once; sources under their weight are drawn again, up to `repetition` times. Within
    a source, epoch e is a permutation by hash of (seed, e, document); a document is drawn if its first token lies
    inside the source's budget. Null sources are one source, null texts count one token, rows that repeat a doc_id are
    drawn one by one. An empty table gives no rows. Order by (block, slot_key) to read the mixture.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), token_count(text_col).alias("tokens"), F.xxhash64(text_of(text_col)).alias("h"))
    rows = stored(rows, "mix-rows")
    sources = stored(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    alpha = exponent(sources, target_entropy, repetition)
    share = weights(sources, alpha)
    share = stored(share.withColumnRenamed("tokens", "total_tokens").join(sources.select("source", "docs"), "source"), "mix-weights")
    n_sources, budget = share.agg(F.count("*"), F.coalesce(F.sum(F.col("epochs") * F.col("total_tokens")), F.lit(0.0))).first()
    blocks = max(1, int(budget // block_tokens))
    # sources are many or few: broadcast only a table of a checked size
    joined = rows.join(F.broadcast(share) if n_sources <= 10_000 else share, "source")
    drawn = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("epochs") - F.lit(1e-9)).cast("int") - 1)))
    # prefix sums in two levels: within hash buckets of bounded size, then over the buckets' totals
    key = F.xxhash64(F.lit(seed), "epoch", "doc_id", "h")
    drawn = drawn.withColumn("key", key).withColumn("bucket", F.floor((F.col("key") / F.lit(2.0**64) + F.lit(0.5)) * (F.floor(F.col("docs") / F.lit(ROWS_PER_BUCKET)) + 1)).cast("long"))
    sums = drawn.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("prior", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(bases, ["source", "epoch", "bucket"])
    at = (F.col("base") + F.col("prior")) / (F.col("epochs") * F.col("total_tokens"))
    placed = placed.withColumn("at", at).filter("epoch = 0 or at < 1")
    return placed.select("doc_id", "source", F.col("epoch").cast("int"), "tokens", "weight", F.lit(alpha).alias("alpha"), F.least(F.floor(F.col("at") * blocks), F.lit(blocks - 1)).cast("long").alias("block"), F.xxhash64(F.lit(seed + 1), "key", "epoch").alias("slot_key"), "h")


def apply_mix(docs: DataFrame, mixture: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row as often as the mixture draws it, laid out by the mixture: each partition has a hash share of
    the documents in the order of (block, slot_key), so that consecutive rows are of one block or of neighbouring ones.

    The texts are shuffled once. The first and the last draw of a document have their own places, draws between them the
    place of the last. Rows that repeat a doc_id and text share these places, and one of them takes their further draws.
    Rows with a null doc_id stay once, at the start.
    """
    place = F.struct("block", "slot_key")
    draws = mixture.filter("doc_id is not null").groupBy("doc_id", "h").agg(F.count_if(F.col("epoch") > 0).alias("_rm_again"), F.min(place).alias("_rm_first"), F.max(place).alias("_rm_last")).withColumnsRenamed({"doc_id": "_rm_doc", "h": "_rm_h"})
    keyed = docs.withColumn("_rm_hash", F.xxhash64(text_of(text_col)))
    met = keyed.join(draws, (F.col(id_col) == F.col("_rm_doc")) & (F.col("_rm_hash") == F.col("_rm_h")), "left")
    first = F.row_number().over(Window.partitionBy(id_col, "_rm_hash").orderBy(id_col)) == 1
    times = F.when(first, F.coalesce("_rm_again", F.lit(0))).otherwise(F.lit(0)).cast("int")
    rows = met.withColumn("_rm_times", times).withColumn("_rm_copy", F.explode(F.sequence(F.lit(0), F.col("_rm_times"))))
    at = F.when(F.col("_rm_copy") == 0, F.col("_rm_first")).otherwise(F.col("_rm_last"))
    return rows.withColumn("_rm_at", at).sortWithinPartitions("_rm_at").select(*docs.columns)
