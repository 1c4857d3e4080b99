"""Per-domain circuit breaker: closed, or open with a cooldown that grows with each refusal.

Batch: the state after all outcomes, by windows over a domain's outcomes in order; the window sorts with spilling and
keeps only counters, whatever the number of outcomes.  Stream: the same transition as keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds (fixed values), in seconds: a refusal's first cooldown without and with a wait asked for, its greatest, and
#: that of a domain that forbids; refusals of the latter kind that open the circuit, and the most doublings.
FALLBACK, LEAST, MOST, FORBIDDEN, FORBIDDEN_RUNS, DOUBLINGS = 900, 30, 86_400, 21_600, 3, 3


def fold(outcomes: DataFrame) -> DataFrame:
    """(domain, circuit, n429, n403, cooldown_until) of (domain, id, ts seconds, status int, wait seconds or null).

    Outcomes are taken in order of (ts, id).  429 opens with a wait that doubles with each one before it in a row; 403
    opens from the third in a row; success closes and clears the cooldown; anything else closes.  A cooldown is never
    shortened but by success.
    """
    order = Window.partitionBy("domain").orderBy("ts", "id")
    c = F.col
    kind = F.when(c("status") == 429, "a").when(c("status") == 403, "f").when(c("status").between(200, 299), "s").otherwise("t")
    o = outcomes.withColumn("kind", kind)
    o = o.withColumn("run", F.sum((F.lag("kind").over(order) != c("kind")).cast("int")).over(order)).na.fill(0, ["run"])
    before = F.row_number().over(Window.partitionBy("domain", "run").orderBy("ts", "id")) - 1
    o = o.withColumn("before", before).withColumn("epoch", F.count_if(c("kind") == "s").over(order))
    double = F.pow(F.lit(2), F.least(c("before"), F.lit(DOUBLINGS)))
    wait = F.when(c("kind") == "a", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce("wait", F.lit(FALLBACK))))).when((c("kind") == "f") & (c("before") + 1 >= FORBIDDEN_RUNS), F.lit(FORBIDDEN))
    o = o.withColumn("asked", wait).withColumn("until", F.when(c("asked").isNotNull(), c("ts") + F.least(F.lit(MOST), c("asked") * double)))
    last = o.groupBy("domain").agg(F.max(F.struct("ts", "id", "kind", "before", "epoch", "run")).alias("l"))
    cool = o.groupBy("domain", "epoch").agg(F.max("until").alias("until"))
    n = lambda k: F.when(c("l.kind") == k, c("l.before") + 1).otherwise(0)
    j = last.join(cool.withColumnRenamed("domain", "d"), (c("domain") == c("d")) & (c("l.epoch") == c("epoch")), "left")
    open_ = (c("l.kind") == "a") | ((c("l.kind") == "f") & (n("f") >= FORBIDDEN_RUNS))
    return j.select("domain", F.when(open_, "OPEN").otherwise("CLOSED").alias("circuit"), n("a").cast("int").alias("n429"), n("f").cast("int").alias("n403"), F.when(c("l.kind") != "s", c("until")).cast("long").alias("cooldown_until"))


def step(state: tuple, ts: int, status: int, wait: float | None) -> tuple:
    """The transition: (circuit, n429, n403, cooldown_until) after one outcome."""
    _, n429, n403, until = state
    if status is not None and 200 <= status <= 299:
        return "CLOSED", 0, 0, None
    if status == 429:
        base = max(LEAST, min(MOST, FALLBACK if wait is None or wait != wait else wait))
        new = ts + int(min(MOST, base * 2 ** min(n429, DOUBLINGS)))
        return "OPEN", n429 + 1, 0, max(until or new, new)
    if status == 403:
        if n403 + 1 < FORBIDDEN_RUNS:
            return "CLOSED", 0, n403 + 1, until
        new = ts + int(min(MOST, FORBIDDEN * 2 ** min(n403, DOUBLINGS)))
        return "OPEN", 0, n403 + 1, max(until or new, new)
    return "CLOSED", 0, 0, until


def stream(outcomes: DataFrame) -> DataFrame:
    """fold() as a streaming query in update mode: a row for each domain that a batch touches.  Outcomes of a domain
    are ordered within a batch; batches must come in order."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else ("CLOSED", 0, 0, None)
        for ts, _, status, wait in sorted((r for b in batches for r in zip(b["ts"], b["id"], b["status"], b["wait"])), key=lambda r: (r[0], r[1])):
            s = step(s, int(ts), int(status), wait)
        state.update(s)
        yield pd.DataFrame({"domain": [key[0]], "circuit": [s[0]], "n429": [s[1]], "n403": [s[2]], "cooldown_until": pd.array([s[3]], dtype="Int64")})

    schema = "circuit string, n429 int, n403 int, cooldown_until long"
    return outcomes.groupBy("domain").applyInPandasWithState(update, "domain string, " + schema, schema, "update", "NoTimeout")


def activity(events: DataFrame, late: str = "1 hour", span: str = "1 hour") -> DataFrame:
    """Events by kind and span of their time, as a stream with a watermark or as a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("at"), "event_type", "n", "total")
