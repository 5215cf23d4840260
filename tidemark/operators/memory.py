"""Recall of resolved investigations that resemble a current one.

Investigations with the same dataset, metrics and columns score alike against anything, so the past is
first reduced to its distinct signatures, each with its newest members. The current investigations are the stated
requests: in blocks, they are scored against the whole past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.shared import settle

#: Current signatures that are scored in one scan of the past.
BLOCK = 200

# Weights of a shared dataset, metric and column, and the highest score.
SAME_DATASET = 0.5
SHARED_METRIC = 0.3
SHARED_COLUMN = 0.3
MAX_SCORE = 1.0


def signatures(investigations: DataFrame, traits: DataFrame) -> DataFrame:
    """Sorted metric and column sets of each investigation.

    ``investigations``: (investigation_id, dataset_name, ...); ``traits``: (investigation_id, metric, column).
    Sets hold distinct names only, however many findings repeat them.
    """
    sets = traits.groupBy("investigation_id").agg(
        F.sort_array(F.collect_set("metric")).alias("metrics"), F.sort_array(F.collect_set("column")).alias("columns")
    )
    empty = F.array().cast("array<string>")
    return investigations.join(sets, "investigation_id", "left").withColumn(
        "metrics", F.coalesce("metrics", empty)
    ).withColumn("columns", F.coalesce("columns", empty))


def _named(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _signature(df: DataFrame) -> DataFrame:
    text = F.to_json(F.struct(_named("dataset_name").alias("d"), "metrics", "columns"))
    return df.withColumn("_sig", F.sha2(text, 256))


def similar(current: DataFrame, resolved: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best past matches of each current investigation, newest first among equals.

    Both sides come from ``signatures``; ``resolved`` also holds created_at, title, root_cause, resolved_at.
    """
    past = _newest_members(_signature(resolved), k + 1)
    now = _signature(current.select("investigation_id", "dataset_name", "metrics", "columns"))
    # Each signature goes by the id of one member: numbers make smaller keys than the signature text.
    past_sig = past.filter("_nth = 1").withColumnRenamed("investigation_id", "_past")
    now_sig = settle(now.groupBy("_sig").agg(
        F.min("investigation_id").alias("_now"),
        *[F.any_value(c).alias(c) for c in ("dataset_name", "metrics", "columns")],
    ))
    overlap = _scored(now_sig, past_sig)
    best = _best_signatures(overlap.withColumn("similarity_score", score()), k + 1)
    wanted = now.select(
        F.col("investigation_id").alias("current_id"), "_sig", F.col("dataset_name").alias("current_dataset"),
        F.col("metrics").alias("_cm"), F.col("columns").alias("_cc"),
    )
    members = past.join(past_sig.select("_sig", "_past"), "_sig").drop("_sig", "_nth")
    pairs = (
        wanted.join(now_sig.select("_sig", "_now"), "_sig")
        .join(best, "_now")
        .join(members, "_past")
        .filter(F.col("current_id") != F.col("investigation_id"))
    )
    order = W.partitionBy("current_id").orderBy(
        F.desc("similarity_score"), F.desc("created_at"), F.desc("investigation_id")
    )
    top = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.withColumn("matched_factors", factors()).drop("_sig", "_now", "_past", "_cm", "_cc", "metrics", "columns")


def _scored(now_sig: DataFrame, past_sig: DataFrame) -> DataFrame:
    """Shared traits of each current signature with each past one that shares any.

    The requests go to the past in blocks of about ``BLOCK`` signatures, each an array in every row of one scan, so no
    trait is a join key: a metric that half of the past has costs no more than any other. Scores are made and ranked
    where the past rows are, before any shuffle.
    """
    n_blocks = max(1, -(-now_sig.count() // BLOCK))
    out = None
    for i in range(n_blocks):
        block = now_sig.filter(F.pmod(F.xxhash64("_sig"), F.lit(n_blocks)) == i)
        asked = block.agg(F.collect_list(F.struct("_now", _named("dataset_name").alias("d"), "metrics", "columns"))).scalar()
        pairs = past_sig.select("_past", "created_at", _named("dataset_name").alias("_d"), "metrics", "columns", F.explode(asked).alias("_c"))
        rows = pairs.select(
            F.col("_c._now").alias("_now"), "_past", "created_at",
            ((F.col("_d") != "") & (F.col("_d") == F.col("_c.d"))).cast("int").alias("same_dataset"),
            F.size(F.array_intersect("metrics", F.col("_c.metrics"))).alias("n_metrics"),
            F.size(F.array_intersect("columns", F.col("_c.columns"))).alias("n_columns"),
        ).filter("same_dataset + n_metrics + n_columns > 0")
        out = rows if out is None else out.union(rows)
    return out


def _newest_members(resolved: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` of each signature, numbered: later ones outrank no member that is kept.

    Spark applies the row-number limit before the shuffle too, so a signature shared by very many
    investigations sends at most ``n`` rows per task.
    """
    newest = W.partitionBy("_sig").orderBy(F.desc("created_at"), F.desc("investigation_id"))
    return resolved.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= n)


def score() -> Column:
    total = (
        SAME_DATASET * F.col("same_dataset") + SHARED_METRIC * F.col("n_metrics") + SHARED_COLUMN * F.col("n_columns")
    )
    return F.round(F.least(F.lit(MAX_SCORE), total), 6)


def _best_signatures(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best past signatures of each current one, by score and then by their newest member.

    Any other signature has ``n`` better ones, each with a member that outranks all of its own.
    """
    top = W.partitionBy("_now").orderBy(F.desc("similarity_score"), F.desc("created_at"), F.desc("_past"))
    return scored.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= n).drop("_rank", "created_at")


def factors() -> Column:
    """Texts that say why two investigations match."""
    metrics = F.array_intersect("_cm", "metrics")
    columns = F.array_intersect("_cc", "columns")
    return F.array_compact(
        F.array(
            F.when(F.col("same_dataset") == 1, F.concat(F.lit("Same dataset ("), F.col("current_dataset"), F.lit(")"))),
            F.when(F.size(metrics) > 0, F.concat(F.lit("Similar metrics: "), F.array_join(metrics, ", "))),
            F.when(F.size(columns) > 0, F.concat(F.lit("Affected columns: "), F.array_join(columns, ", "))),
        )
    )
