"""Counter-based random numbers: every draw is a hash of its counters, so results are the same in any engine and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.scalars import hash64
from tessaline.sources.shared import settle, tasks_of


def with_draws(numbered: DataFrame, replicates: int, stream: str, seed: int = 42) -> DataFrame:
    """Each row of ``numbered`` (with its ``slot``) once per replicate: ``rep``, and ``u``, 64 bits that hang on replicate and slot alone.

    A slot's draws are hashed once for all groups that have it. Neither side of the join is broadcast: Spark doesn't see how long the draws are. ``numbered`` is written down first.
    """
    numbered, tasks = settle(numbered, "numbered"), tasks_of(numbered.sparkSession)
    u = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda rep: hash64(F.concat_ws("|", F.lit(stream), rep.cast("string"), F.col("slot").cast("string")), seed))
    draws = numbered.select("slot").distinct().repartition(tasks, "slot").select("slot", u.alias("_u"))
    return numbered.repartition(tasks, "slot").hint("merge").join(draws.hint("merge"), "slot").select(*numbered.columns, F.posexplode("_u").alias("rep", "u"))


def pick(u: str, n: str) -> Column:
    """Index from 0 to n - 1."""
    return (F.col(u) % F.col(n).cast("decimal(20,0)")).cast("int")
