"""Ledgers, schedules, retries and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.operators.latest import carried
from groundwork.plans.lineage import checkpointed


def quota_ledger(requests: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, units: str = "units") -> DataFrame:
    """keys, order, units, allowed, used_after: in order, a request is allowed if what is used plus
    its units stays within the limit; denied requests use nothing. Rows are sorted within keys
    (provider and period) and read a batch at a time; only what is used is carried on."""
    rows = requests.select(*keys, *order, F.col(units).cast("long").alias("units"))

    def start() -> int:
        return 0

    def step(used: int, n: int | None) -> tuple[int, tuple]:
        ok = None if n is None else used + n <= limit
        used = used + n if ok else used
        return used, (ok, used)

    return carried(rows, keys, [F.col(c) for c in (*order, "units")], "units", start, step, "allowed boolean, used_after long")


def issue_date(ts: Column) -> Column:
    """The daily issue of an instant: days that begin at 01:00 UTC."""
    return F.to_date(ts - F.expr("interval 1 hour"))


def issue_gaps(issues: DataFrame, first: str, last: str, at: str = "issue_date") -> DataFrame:
    """Days from ``first`` to ``last`` without an issue."""
    days = issues.sparkSession.sql(f"select explode(sequence(date '{first}', date '{last}')) as {at}")
    return days.join(issues.select(at).distinct(), at, "left_anti")


def stage_metrics(events: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    d = F.col(duration)
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"))


def usage_rollup(usage: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])


def admission_report(runs: DataFrame, most: int) -> DataFrame:
    active = F.count_if(F.col("status").isin("queued", "running", "publishing"))
    return runs.agg(active.alias("active"), (F.lit(most) - active).alias("free"))


def attempt_budgets(attempts: DataFrame, unit: str, most: int = 2) -> DataFrame:
    """unit, spent, left, next_action."""
    by = attempts.groupBy(unit).agg(F.count("*").alias("spent"))
    return by.withColumn("left", F.greatest(F.lit(most) - F.col("spent"), F.lit(0))).withColumn("next_action", F.when(F.col("left") > 0, "retry").otherwise("stop"))


def retry_plan(runs: DataFrame, now: Column, most: int = 2) -> DataFrame:
    """Failed, retryable runs without a media id, fewer than ``most`` retries, younger than a day,
    with the time of the next attempt: after 60 s, then after 300 s."""
    fit = runs.filter((F.col("status") == "failed") & F.col("retryable") & F.col("media_id").isNull() & (F.col("retry_count") < most) & (F.col("created_at") > now - F.expr("interval 1 day")))
    return fit.withColumn("retry_at", F.when(F.col("retry_count") == 0, now + F.expr("interval 60 seconds")).otherwise(now + F.expr("interval 300 seconds")))


def debounced(messages: DataFrame, thread: str, ts: str, gap: str) -> DataFrame:
    """thread, started, last_edit, ready_at, n: runs of edits no further than ``gap`` apart; a run is
    ready ``gap`` after its last edit."""
    by = messages.groupBy(thread, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("last_edit"), F.count("*").alias("n"))
    return by.select(thread, F.col("w.start").alias("started"), "last_edit", F.col("w.end").alias("ready_at"), "n")


def recent_reasons(audits: DataFrame, scope: str, order: str, n: int = 6, cut: int = 500) -> DataFrame:
    """The last ``n`` distinct reasons of each scope."""
    one = audits.withColumn("reason", F.left("reason", F.lit(cut))).groupBy(scope, "reason").agg(F.max(order).alias("last"))
    rank = F.row_number().over(W.partitionBy(scope).orderBy(F.col("last").desc(), "reason"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= n).select(scope, "rank", "reason")


#: (section, group, slots, least): a section is well if one of its groups has ``least`` slots that are well.
Rule = tuple[str, str, Sequence[str], int]


def collection_health(slots: DataFrame, rules: Sequence[Rule], needed: Sequence[str] = (), run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(run, section, ok) for every run of slots (run_id, slot_id, ok), and (run, healthy, failed):
    healthy where all sections in ``needed`` (all, where none is named) are well; failed lists the
    slots that are not. ``rules`` are a short list."""
    one = slots.groupBy(run, "slot_id").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"))
    held = [F.struct(F.lit(section).alias("section"), (F.count_if(F.col("ok") & F.col("slot_id").isin(*ids)) >= least).alias("ok")) for section, _, ids, least in rules]
    by = one.groupBy(run).agg(F.array(*held).alias("groups"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("slot_id")))), ",").alias("failed"))
    sections = by.select(run, F.explode("groups").alias("g")).groupBy(run, F.col("g.section").alias("section")).agg(F.bool_or("g.ok").alias("ok"))
    asked = sections.filter(F.col("section").isin(*needed)) if needed else sections
    whole = asked.groupBy(run).agg(F.bool_and("ok").alias("healthy"))
    return sections, by.select(run, "failed").join(whole, run)


def issue_states(issues: DataFrame, today: str, days: int = 30, keep: int = 7, at: str = "issue_date") -> DataFrame:
    """(issue_date, state) of the last ``days`` days: done where a row (issue_date, done) says so,
    catch-up where it is missing and younger than ``keep`` days, else expired."""
    calendar = issues.sparkSession.sql(f"select explode(sequence(date '{today}' - interval {days - 1} days, date '{today}')) as {at}")
    done = issues.groupBy(at).agg(F.bool_or("done").alias("done"))
    age = F.date_diff(F.to_date(F.lit(today)), F.col(at))
    state = F.when(F.coalesce("done", F.lit(False)), "done").when(age < keep, "catch-up").otherwise("expired")
    return calendar.join(done, at, "left").select(at, state.alias("state"))


#: Size of a sketch; its ranks are off by less than 2.3 / SKETCH ** 0.97 of all rows, at 99 percent.
SKETCH = 800


def duration_sketches(events: DataFrame, keys: Sequence[str], duration: str = "duration_ms", size: int = SKETCH) -> DataFrame:
    """(keys, n, sketch): a mergeable quantile sketch of the durations of each key, such as a stage and a
    day, of bounded size; to be kept, and merged into sketches of longer times. Null durations count
    in neither."""
    return events.groupBy(*keys).agg(F.count(duration).alias("n"), F.kll_sketch_agg_double(F.col(duration).cast("double"), size).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], size: int = SKETCH) -> DataFrame:
    """(keys, n, sketch) over what was kept for finer keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketch_quantile(sketches: DataFrame, q: float) -> Column:
    """The quantile that a sketch tells; null for none."""
    return F.when(sketches["n"] > 0, F.kll_sketch_get_quantile_double(sketches["sketch"], F.lit(q)))


def _beside(rows: DataFrame, told: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with what is told of their keys; a null key is a key."""
    other = told.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
    return rows.join(other, same, how).drop(*[f"_of_{k}" for k in keys])


def quantile_ranks(events: DataFrame, told: DataFrame, keys: Sequence[str], duration: str = "duration_ms") -> DataFrame:
    """(keys, below, upto): the exact shares of durations below, and at most, the value told (keys,
    value); a told quantile q is off by max(0, below - q, q - upto)."""
    d = _beside(events.filter(F.col(duration).isNotNull()), told.select(*keys, F.col("value").alias("_value")), keys, "inner")
    share = lambda c: F.avg(c.cast("int"))
    return d.groupBy(*keys).agg(share(F.col(duration) < F.col("_value")).alias("below"), share(F.col(duration) <= F.col("_value")).alias("upto"))


def exact_quantile(events: DataFrame, keys: Sequence[str], q: float, duration: str = "duration_ms") -> DataFrame:
    """(keys, value): the quantile q of the durations of each key, between its two neighbours in
    proportion; keys without a duration have no row. The values of all keys, each once with its count,
    are sorted over ranges and counted by range, so that a long key is spread over tasks; only ranges
    that hold a neighbour are numbered. NaN is above all others."""
    d = events.select(*keys, F.col(duration).cast("double").alias("_v")).filter("_v is not null")
    each = d.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    each = checkpointed(each.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    key = W.partitionBy(*keys)
    ends = each.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in")).withColumn("_at", (F.sum("_in").over(key) - 1) * F.lit(q))
    ends = ends.withColumn("_before", F.sum("_in").over(key.orderBy("_part")) - F.col("_in"))
    held = ends.filter((F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_in") > F.floor("_at")))
    near = _beside(each, held.drop("_in"), [*keys, "_part"], "inner")
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy("_v"))
    first = lambda at: F.min(F.when(F.col("_upto") > at, F.col("_v")))
    two = near.withColumn("_upto", upto).groupBy(*keys, "_at").agg(first(F.floor("_at")).alias("_a"), first(F.ceil("_at")).alias("_b"))
    beyond = F.col("_at") - F.floor("_at")
    between = F.col("_a") * (1 - beyond) + F.col("_b") * beyond
    return two.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("value"))


def stage_report(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, failures, retries, hit_rate and the 95th percentile of duration_ms of stages, exact as p95 and
    as a sketch of the numbers among them tells it: telemetry (outcome, attempt, retrying, cache_hit,
    duration_ms)."""
    number = F.nanvl(F.col("duration_ms").cast("double"), F.lit(None).cast("double"))
    by = events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") != "ok").alias("failures"), F.count_if(F.col("retrying") | (F.col("attempt") > 1)).alias("retries"),
        F.avg(F.col("cache_hit").cast("int")).alias("hit_rate"), F.count(number).alias("_n"), F.kll_sketch_agg_double(number, SKETCH).alias("_sketch"),
    )
    by = by.withColumn("p95_sketch", F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.95)))).drop("_n", "_sketch")
    return _beside(by, exact_quantile(events, keys, 0.95).withColumnRenamed("value", "p95"), keys)
