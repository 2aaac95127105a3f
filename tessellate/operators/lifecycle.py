"""A record's life: legal transitions, replay, idempotent delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .running import free_names

#: The transition table, source state to destinations.
TRANSITIONS = {
    "CAPTURÉ": ["EN_ATTENTE_IA", "DOUBLON_SUSPECTÉ"],
    "DOUBLON_SUSPECTÉ": ["EN_ATTENTE_IA", "À_RÉVISER", "VALIDÉ"],
    "EN_ATTENTE_IA": ["TRAITÉ_IA", "ÉCHEC_TRAITEMENT", "RÉVISION_MANUELLE_REQUISE"],
    "ÉCHEC_TRAITEMENT": ["EN_ATTENTE_IA", "RÉVISION_MANUELLE_REQUISE"],
    "TRAITÉ_IA": ["À_RÉVISER", "VALIDÉ", "DOUBLON_SUSPECTÉ"],
    "À_RÉVISER": ["VALIDÉ", "CAPTURÉ", "RÉVISION_MANUELLE_REQUISE"],
    "RÉVISION_MANUELLE_REQUISE": ["VALIDÉ", "CAPTURÉ"],
    "VALIDÉ": ["PATIENTE_LIÉE", "RÉVISION_MANUELLE_REQUISE"],
    "PATIENTE_LIÉE": ["ENREGISTRÉ"],
    "ENREGISTRÉ": ["SYNCHRONISÉ", "ÉCHEC_SYNCHRO"],
    "ÉCHEC_SYNCHRO": ["ENREGISTRÉ"],
    "SYNCHRONISÉ": [],
}


def transition_table(spark: SparkSession, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in transitions.items() for b in bs], "src string, dst string")


def checked(steps: DataFrame, transitions: DataFrame) -> DataFrame:
    """steps (src, dst, ...) with `legal`: whether the table has the step. Its size decides how it is joined."""
    t = transitions.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    return steps.join(t, (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")), "left").withColumn("legal", F.col("__s").isNotNull()).drop("__s", "__d")


def replayed(log: DataFrame, record: str, order: str, state: str) -> DataFrame:
    """The last state of each record of an append-only log."""
    return log.groupBy(record).agg(F.max_by(state, order).alias(state))


def rate_limited(events: DataFrame, key: str, time: str, seconds: int, most: int, name: str = "limited") -> DataFrame:
    """Whether a row is at least the most-th of its key within the last so many seconds (itself included). A row stands in its own stretch of that length and, as what
    came before, in the next one, so that a key with very many rows is dealt over its stretches."""
    t, stretch, own = free_names(events, "seconds_of_row", "stretch", "own_stretch")
    copies = events.withColumn(t, F.unix_seconds(F.col(time).cast("timestamp"))).withColumn(own, F.floor(F.col(t) / seconds))
    copies = copies.withColumn(stretch, F.explode(F.array(F.col(own), F.col(own) + 1)))
    w = Window.partitionBy(key, stretch).orderBy(t).rangeBetween(-seconds, 0)
    return copies.withColumn(name, F.count("*").over(w) >= most).filter(F.col(own) == F.col(stretch)).drop(t, stretch, own)


def backoff(attempts, cap: int = 600):
    """Seconds until the next try: doubled each time, up to a cap."""
    return F.least(F.lit(cap), F.pow(F.lit(2.0), F.least(attempts, F.lit(20))).cast("int"))
