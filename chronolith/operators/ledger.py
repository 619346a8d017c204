"""The prediction ledger: states at a time, and settlement by the first later observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import log_loss
from .dedup import latest, reasons


def ledger_states(predictions: DataFrame, now: Column) -> DataFrame:
    """``state`` and the reasons ``why`` of rows with predicted_at, kickoff and traced: invalid if made
    at kickoff or later, or untraced; frozen from kickoff on; else open."""
    why = reasons(("not_before_kickoff", F.col("predicted_at") >= F.col("kickoff")), ("untraced", ~F.col("traced")))
    state = F.when(F.size(why) > 0, "invalid").when(F.col("kickoff") <= now, "frozen").otherwise("open")
    return predictions.withColumn("why", why).withColumn("state", state)


def replaced(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each match_id: a newer prediction replaces an open one before kickoff; frozen and
    evaluated rows stay. Both have match_id, predicted_at, kickoff, state."""
    s, b = stored.alias("s"), latest(batch, ["match_id"], [F.desc("predicted_at")]).alias("b")
    take = (F.col("s.match_id").isNull()) | ((F.col("s.state") == "open") & (F.col("b.state") == "open") & (F.col("b.predicted_at") > F.col("s.predicted_at")) & (F.col("b.predicted_at") < F.col("s.kickoff")))
    j = s.join(b, F.col("s.match_id") == F.col("b.match_id"), "full_outer").withColumn("__take", F.col("b.match_id").isNotNull() & F.coalesce(take, F.lit(False)))
    return j.select(*[F.when(F.col("__take"), F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in stored.columns])


def settle(predictions: DataFrame, observations: DataFrame, order: list[str]) -> DataFrame:
    """Each prediction with its first observation strictly after it: y, correct and log_loss."""
    j = predictions.join(observations, "match_id").where(F.col("seen_at") > F.col("predicted_at"))
    first = latest(j, ["match_id"], order)
    right = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")
    return first.withColumn("correct", right).withColumn("log_loss", log_loss(F.col("y"), F.col("p")))
