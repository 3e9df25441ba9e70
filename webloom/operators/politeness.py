"""Per-domain politeness in batch: admission (F3) and schedule (F4) of `arrivals(arrival_id, domain, url, ts)`.

Both rules run through the arrivals of a domain in order, and one domain may hold a large part of all arrivals. The
arrivals are therefore cut into blocks by range partitioning on (domain, ts, url, arrival_id): a popular domain spans
many blocks of bounded size, and what one block passes on to the next is a single number per domain. Both rules are
prefix operations over the blocks, so no block waits for the one before it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.session import written

PERIOD_SECONDS = 30  # fixed value: one fetch per domain in this time
ORDER = ("domain", "ts", "url", "arrival_id")
ROWS_PER_BLOCK = 250_000
FAN_IN = 8


def micros(rows: DataFrame, column: str = "ts") -> Column:
    """A timestamp column in microseconds; one without time zone counts as UTC, whatever the session zone is."""
    if isinstance(rows.schema[column].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column))


def blocks(arrivals: DataFrame, count: int | None = None, *keep: str) -> DataFrame:
    """arrival_id, domain, url, ts (microseconds), block, seq; blocks are ranges of ORDER, numbered in that order.

    seq numbers the rows in that order. Written to storage, because block and seq are only meaningful for one
    evaluation of the range bounds.
    `count` fixes the number of blocks; by default a block holds about ROWS_PER_BLOCK arrivals.
    """
    narrow = arrivals.filter(F.col("domain").isNotNull()).select(
        "arrival_id", "domain", "url", micros(arrivals).alias("ts"), *keep
    )
    if count is None:
        count = max(1, -(-narrow.count() // ROWS_PER_BLOCK))
    ranged = narrow.repartitionByRange(count, *ORDER).sortWithinPartitions(*ORDER)
    numbered = ranged.withColumn("block", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    return written(numbered, "arrivals", "block")


def schedule(arrivals: DataFrame, period_seconds: int = PERIOD_SECONDS, count: int | None = None) -> DataFrame:
    """arrival_id, domain, url, ts, slot: the time at which a postponed arrival gets its turn; nothing is dropped.

    slot_i = max over j <= i of (ts_j - period * j) + period * i, with i, j numbering the arrivals of a domain. The
    number and the maximum are first taken within a block, then shifted by what the earlier blocks of the domain hold.
    """
    period = F.lit(period_seconds * 1_000_000).cast("long")
    here = Window.partitionBy("domain", "block").orderBy("seq")
    local = (
        blocks(arrivals, count)
        .withColumn("n", F.row_number().over(here).cast("long"))
        .withColumn("lead", F.col("ts") - period * F.col("n"))
        .withColumn("lead", F.max("lead").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # One row per domain and block: a domain has at most as many rows here as there are blocks.
    earlier = Window.partitionBy("domain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy("domain", "block")
        .agg(F.max("n").alias("size"), F.max("lead").alias("lead"))
        .withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("carry", F.max(F.col("lead") - period * F.col("before")).over(earlier))
        .select("domain", "block", "before", "carry")
    )
    shifted = F.col("lead") - period * F.col("before")
    slot = F.greatest(shifted, F.col("carry")) + period * (F.col("before") + F.col("n"))
    return local.join(carried, ["domain", "block"]).select(
        "arrival_id",
        "domain",
        "url",
        F.timestamp_micros("ts").alias("ts"),
        F.timestamp_micros(slot).alias("slot"),
    )


def admitted_positions(ts: np.ndarray, period: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Positions of the admitted entries of sorted `ts` after an admission at `last`, and the last admission."""
    flags = np.zeros(len(ts), dtype=bool)
    at = 0 if last is None else int(np.searchsorted(ts, last + period, side="left"))
    while at < len(ts):
        flags[at] = True
        last = int(ts[at])
        at = int(np.searchsorted(ts, last + period, side="left"))
    return flags, last


def _flags(ts: np.ndarray, domain: np.ndarray, since: np.ndarray, period: int) -> np.ndarray:
    """Admission flags of a sorted block; `since` is the last admission before a domain's rows here, NaN if none.

    An arrival a whole period after the one before it is admitted whatever came earlier, so only stretches of closer
    arrivals are walked. While the admission before the block still matters, the whole domain is walked.
    """
    first = np.r_[True, domain[1:] != domain[:-1]]
    restart = first | np.r_[True, np.diff(ts) >= period]
    flags = restart.copy()
    starts = np.flatnonzero(restart)
    ends = np.r_[starts[1:], len(ts)]
    close = ends - starts > 1
    for start, end in zip(starts[close], ends[close]):
        flags[start:end], _ = admitted_positions(ts[start:end], period, None)
    heads = np.flatnonzero(first)
    head_ends = np.r_[heads[1:], len(ts)]
    held = ts[heads] - since[heads] < period
    for start, end in zip(heads[held], head_ends[held]):
        flags[start:end], _ = admitted_positions(ts[start:end], period, int(since[start]))
    return flags


# A step function from the last admission before some arrivals to the last one after them: if the first arrival that
# may be admitted is at most t[i] (and after t[i - 1]), the result is v[i]; beyond the last t nothing is admitted.
Steps = tuple[np.ndarray, np.ndarray]


def _pruned(t: np.ndarray, v: np.ndarray, bound: int) -> Steps:
    """Drop steps that no admission before the arrivals can reach, and join neighbours with one result.

    What is left is at most one period of arrivals of one domain, however many arrivals the function stands for.
    """
    keep = int(np.searchsorted(t, bound, side="left")) + 1
    t, v = t[:keep], v[:keep]
    ends = np.r_[v[1:] != v[:-1], True]
    return t[ends], v[ends]


def transfer(ts: np.ndarray, period: int, bound: int) -> Steps:
    """Steps of sorted arrivals: follow "next admission" from every arrival at once, by pointer doubling."""
    following = np.searchsorted(ts, ts + period, side="left")
    target = np.where(following < len(ts), following, np.arange(len(ts)))
    while not np.array_equal(further := target[target], target):
        target = further
    return _pruned(ts, ts[target], bound)


def _after(steps: Steps, last: np.ndarray, period: int) -> np.ndarray:
    t, v = steps
    at = np.searchsorted(t, last + period, side="left")
    return np.where(at < len(t), v[np.minimum(at, len(t) - 1)], last)


def composed(parts: list[Steps], period: int, bound: int) -> Steps:
    """Steps of several groups of arrivals that follow each other."""
    t, v = parts[0]
    for part in parts[1:]:
        t, v = _pruned(np.concatenate([t, part[0]]), np.concatenate([_after(part, v, period), part[1]]), bound)
    return t, v


_NODE = "domain string, k long, base long, since long, t array<long>, v array<long>"


def _nodes(segments: pd.DataFrame) -> list[Steps]:
    return [(np.asarray(t), np.asarray(v)) for t, v in zip(segments["t"], segments["v"])]


def carried(rows: DataFrame, period: int) -> DataFrame | None:
    """domain, block, carry: the last admission before each block of a domain that spans several; None without such.

    A prefix scan over step functions. Blocks are turned into functions in parallel, runs of FAN_IN of them composed
    level by level until a domain has one run left, and the admissions handed down through the levels again. No task
    holds more than FAN_IN functions of at most a period of arrivals each, and nothing passes through the driver.
    """
    spans = Window.partitionBy("domain")
    segments = written(
        rows.groupBy("domain", "block")
        .agg(F.first("since").alias("since"))
        .withColumn("parts", F.count(F.lit(1)).over(spans))
        .filter("parts > 1")
        .withColumn("k", F.row_number().over(spans.orderBy("block")).cast("long") - 1),
        "segments",
    )
    longest = segments.agg(F.max("parts")).first()[0]
    if longest is None:
        return None

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["ts"].to_numpy())
        since = pdf["since"].iloc[0]
        base = int(ts[0]) if pd.isna(since) else max(int(ts[0]), int(since))
        t, v = transfer(ts, period, base + period)
        head = pdf[["domain", "k", "since"]].iloc[:1].assign(base=base, t=[t], v=[v])
        return head[["domain", "k", "base", "since", "t", "v"]]

    def join_run(pdf: pd.DataFrame) -> pd.DataFrame:
        run = pdf.sort_values("k", ignore_index=True)
        base = int(run["base"].iloc[0])
        t, v = composed(_nodes(run), period, base + period)
        head = run[["domain", "parent", "base", "since"]].iloc[:1].rename(columns={"parent": "k"})
        return head.assign(t=[t], v=[v])[["domain", "k", "base", "since", "t", "v"]]

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        run = pdf.sort_values("k", ignore_index=True)
        last = None if pd.isna(run["carry"].iloc[0]) else int(run["carry"].iloc[0])
        out = []
        for t, v in _nodes(run):
            out.append(last)
            last = int(v[0]) if last is None else int(_after((t, v), np.asarray([last]), period)[0])
        return pd.DataFrame({"domain": run["domain"], "k": run["k"], "carry": pd.array(out, dtype="Int64")})

    parent = F.floor(F.col("k") / FAN_IN).alias("parent")
    spread_rows = rows.select("domain", "block", "ts", "since").join(
        segments.select("domain", "block", "k"), ["domain", "block"]
    )
    levels = [written(spread_rows.groupBy("domain", "k").applyInPandas(leaf, _NODE), "steps")]
    while longest > FAN_IN:
        runs = levels[-1].select("*", parent).groupBy("domain", "parent")
        levels.append(written(runs.applyInPandas(join_run, _NODE), "steps"))
        longest = -(-longest // FAN_IN)
    root = F.lit(0).cast("long").alias("parent")
    down = segments.filter("k = 0").select("domain", root, F.col("since").alias("carry"))
    for nodes in reversed(levels):
        runs = nodes.select("*", parent).join(down, ["domain", "parent"]).groupBy("domain", "parent")
        handed = written(runs.applyInPandas(hand_down, "domain string, k long, carry long"), "carries")
        down = handed.withColumnRenamed("k", "parent")
    return segments.join(handed, ["domain", "k"]).select("domain", "block", "carry")


def admit(
    arrivals: DataFrame,
    period_seconds: int = PERIOD_SECONDS,
    count: int | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """arrival_id, domain, url, ts, admitted: true iff no arrival of the domain was admitted in the period before it.

    A refused arrival does not extend the period. `earlier(domain, since)` holds the last admission in microseconds
    of domains that were seen before these arrivals.
    """
    period = period_seconds * 1_000_000
    if earlier is None:
        started = arrivals.withColumn("since", F.lit(None).cast("long"))
    else:
        started = arrivals.join(earlier, "domain", "left")
    rows = blocks(started, count, "since")
    carries = carried(rows, period)
    if carries is not None:
        rows = rows.join(carries, ["domain", "block"], "left").withColumn("since", F.coalesce("carry", "since"))

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf.sort_values("seq", ignore_index=True)
        since = block["since"].to_numpy(dtype="float64", na_value=np.nan)
        block["admitted"] = _flags(block["ts"].to_numpy(), block["domain"].to_numpy(), since, period)
        return block[["arrival_id", "domain", "url", "ts", "admitted"]]

    schema = "arrival_id long, domain string, url string, ts long, admitted boolean"
    columns = rows.select("block", "seq", "arrival_id", "domain", "url", "ts", "since")
    flagged = columns.groupBy("block").applyInPandas(flag, schema)
    return flagged.withColumn("ts", F.timestamp_micros("ts"))


def _held_before(arrivals: DataFrame, holds: DataFrame, count: int | None) -> DataFrame:
    """arrivals with `held` (microseconds) and `holder`: the last of `holds` before them in the order of their domain.

    Both tables are cut into blocks together; what a block passes on is its last hold, one row per domain and block.
    """
    columns = ("arrival_id", "domain", "url", "ts")
    both = arrivals.select(*columns, F.lit(False).alias("is_hold")).unionByName(
        holds.select(*columns, F.lit(True).alias("is_hold"))
    )
    rows = blocks(both, count, "is_hold")
    mark = F.when(F.col("is_hold"), F.struct(F.col("ts").alias("held"), F.col("arrival_id").alias("holder")))
    here = Window.partitionBy("domain", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("domain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("is_hold").groupBy("domain", "block").agg(F.max_by(mark, "seq").alias("last"))
    spans = rows.select("domain", "block").distinct().join(last, ["domain", "block"], "left")
    passed_on = spans.select("domain", "block", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    local = rows.withColumn("hold", F.last(mark, ignorenulls=True).over(here)).filter("NOT is_hold")
    found = local.join(passed_on, ["domain", "block"], "left").withColumn("hold", F.coalesce("hold", "carry"))
    return found.select("arrival_id", "domain", "url", F.timestamp_micros("ts").alias("ts"), "hold.held", "hold.holder")


class Decided(NamedTuple):
    """What a round decided: its domains (None: all), and arrival_id, domain, admitted of all their rows; both written."""

    domains: DataFrame | None
    rows: DataFrame


def _latest(rounds: list[Decided]) -> DataFrame:
    """arrival_id, domain, admitted: of each round the domains that no later one has decided again."""
    later, found = None, None
    for domains, rows in reversed(rounds):
        left = rows if later is None else rows.join(later, "domain", "left_anti")
        found = left if found is None else found.unionByName(left)
        later = domains if later is None or domains is None else later.unionByName(domains)
    return found


def _changed(rounds: list[Decided]) -> DataFrame:
    """arrival_id of the rows whose admission the last round has changed."""
    domains, rows = rounds[-1]
    now = rows.filter("admitted").select("arrival_id", F.lit(1).alias("change"))
    if domains is None:
        return now.select("arrival_id")
    before = _latest(rounds[:-1]).join(domains, "domain", "left_semi").filter("admitted")
    both = now.unionByName(before.select("arrival_id", F.lit(-1).alias("change")))
    seen = both.groupBy("arrival_id").agg(F.max("change").alias("now"), F.min("change").alias("before"))
    return seen.filter("now < 0 OR before > 0").select("arrival_id")


def _folded(rounds: list[Decided]) -> list[Decided]:
    """The rounds after the first as one, when there are FAN_IN of them: what reads them all stays small."""
    if len(rounds) <= FAN_IN:
        return rounds
    domains = rounds[1].domains
    for later in rounds[2:]:
        domains = domains.unionByName(later.domains)
    merged = Decided(written(domains.distinct(), "redirect-domains"), written(_latest(rounds[1:]), "redirect-round"))
    return [rounds[0], merged]


def admit_redirected(
    arrivals: DataFrame, period_seconds: int = PERIOD_SECONDS, count: int | None = None, rounds: int = 1000
) -> DataFrame:
    """arrival_id, domain, url, ts, admitted, where an admission holds two domains: the one asked and the one that answers.

    `arrivals(arrival_id, domain, url, ts, answered)`: a row is admitted iff no admission held its domain in the period
    before it, in the order (ts, url, arrival_id) of all rows; an admitted row holds `domain` and, unless that is null or
    the same, `answered`. arrival_id is unique.

    A hold from another domain is like a fresh start: what came before it in the domain no longer matters, since no
    earlier admission is later than it. So holds cut a domain into stretches that the prefix scan of `admit` decides as
    if they were domains of their own. Which holds there are depends on the admissions, so rounds repeat until the
    admissions stay the same. A row depends on earlier ones only: after n rounds all rows are right whose decision
    depends on a chain of fewer than n redirects, and the state that stays the same is the only one.

    A round decides the domains whose holds the round before has changed, and no others: those would come out as they are.
    """
    rows = written(
        arrivals.filter(F.col("domain").isNotNull()).select(
            "arrival_id", "domain", "url", F.timestamp_micros(micros(arrivals)).alias("ts"), "answered"
        ),
        "redirected",
    )
    crossing = rows.filter("answered <> domain").select("arrival_id", F.col("answered").alias("domain"), "url", "ts")
    columns = ("arrival_id", "domain", "admitted")
    done = [Decided(None, written(admit(rows, period_seconds, count).select(*columns), "redirect-round"))]
    for _ in range(rounds):
        changed = written(_changed(done), "redirect-changes")
        moved = crossing.join(changed, "arrival_id", "left_semi").select("domain").distinct()
        domains = written(moved, "redirect-domains")
        if domains.isEmpty():
            decided = _latest(done).select("arrival_id", "admitted")
            return rows.select("arrival_id", "domain", "url", "ts").join(decided, "arrival_id")
        done = _folded(done)
        asking = written(crossing.join(domains, "domain", "left_semi"), "redirect-asking")
        holds = asking.join(_latest(done).filter("admitted").select("arrival_id"), "arrival_id", "left_semi")
        again = rows.select("arrival_id", "domain", "url", "ts").join(domains, "domain", "left_semi")
        decided = _with_holds(again, holds, period_seconds, count).select(*columns)
        done.append(Decided(domains, written(decided, "redirect-round")))
    raise RuntimeError(f"admissions still change after {rounds} rounds")


def _with_holds(rows: DataFrame, holds: DataFrame, period_seconds: int, count: int | None) -> DataFrame:
    """`admit` of whole domains that `holds(arrival_id, domain, url, ts)` from elsewhere cut into stretches."""
    placed = _held_before(rows, holds, count)
    stretch = F.to_json(F.struct(F.col("domain").alias("d"), F.col("holder").cast("string").alias("h")))
    placed = written(placed.withColumn("stretch", stretch), "stretches")
    since = placed.filter("held IS NOT NULL").groupBy(F.col("stretch").alias("domain")).agg(F.max("held").alias("since"))
    pieces = placed.select("arrival_id", F.col("stretch").alias("domain"), "url", "ts")
    decided = admit(pieces, period_seconds, count, written(since, "holds"))
    return decided.withColumn("domain", F.from_json("domain", "d string")["d"])
