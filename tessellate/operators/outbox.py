"""Delivery with retries, recovery after a crash, and what a client does with errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a record that is to be delivered.
SAVED, FAILED, SENT = "ENREGISTRÉ", "ÉCHEC_SYNCHRO", "SYNCHRONISÉ"


def flushed(tries: DataFrame, item: str, time: str, tie: str, ok: str, most: int = 5, cap: int = 600) -> DataFrame:
    """Per item, what its tries in order of time lead to: state, attempts (failures so far), next_try, late (an answer after it had been given up), early (tries before
    they were due, which do nothing). A failure puts the next try off by min(cap, 2 ** attempts) seconds, the most-th gives up; a success ends it: later
    tries do nothing. A fold over each item's own tries, which back-off keeps few; items are independent."""
    state = lambda s, a, n, late, early: F.struct(s.alias("state"), a.cast("int").alias("attempts"), n.cast("long").alias("next_try"), late.alias("late"), early.cast("int").alias("early"))
    start = state(F.lit(SAVED), F.lit(0), F.lit(None), F.lit(False), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        done, waits = acc["state"] == SENT, F.coalesce(x["t"] < acc["next_try"], F.lit(False))
        failed = acc["attempts"] + 1
        again = state(F.when(failed >= most, FAILED).otherwise(acc["state"]), failed, x["t"] + F.least(F.lit(cap), F.pow(F.lit(2.0), F.least(failed, F.lit(30))).cast("long")), acc["late"], acc["early"])
        sent = state(F.lit(SENT), acc["attempts"], F.lit(None), acc["state"] == FAILED, acc["early"])
        early = state(acc["state"], acc["attempts"], acc["next_try"], acc["late"], acc["early"] + 1)
        return F.when(done, acc).when(waits, early).when(x["ok"], sent).otherwise(again)

    folded = tries.groupBy(item).agg(F.reduce(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(tie).alias("tie"), F.col(ok).alias("ok")))), start, step).alias("s"))
    return folded.select(item, "s.*")


def released(log: DataFrame, item: str, order: Column, sent: Column, answered: Column) -> DataFrame:
    """After a crash: per item whether it was in flight (its last dispatch has no later answer), and what is to be sent again. Nothing is in flight any more, and sending
    twice does no harm as the other side knows the key."""
    last = log.groupBy(item).agg(F.max(F.when(sent, order)).alias("dispatched"), F.max(F.when(answered, order)).alias("answered"))
    lost = F.col("dispatched").isNotNull() & F.coalesce(F.col("answered") < F.col("dispatched"), F.lit(True))
    return last.select(item, lost.alias("was_in_flight"), F.lit(0).cast("long").alias("in_flight"), F.when(lost, F.col("dispatched")).alias("send_again"))


def client_queue(log: DataFrame, client: str, order: list[str], code: str, first: int = 2, cap: int = 60) -> DataFrame:
    """log with `action` (done, retry or manual) and `wait`, seconds to the next try: first * 2 ** (failures in a row), up to cap. Refusals of the request itself
    (4xx but for 401, 408, 429) go to a person; no answer at all (null), overload and errors of the server are tried again."""
    c = F.col(code)
    action = F.when(c.isNull() | c.isin(401, 408, 429) | (c >= 500), "retry").when(c.between(400, 499), "manual").otherwise("done")
    upto = Window.partitionBy(client).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = log.withColumn("action", action).withColumn("run", F.sum((F.col("action") == "done").cast("int")).over(upto))
    within = Window.partitionBy(client, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failures = F.sum((F.col("action") == "retry").cast("int")).over(within)
    wait = F.least(F.lit(cap), F.lit(first) * F.pow(F.lit(2.0), F.least(failures, F.lit(20)))).cast("long")
    return x.withColumn("wait", F.when(F.col("action") == "retry", wait)).drop("run")
