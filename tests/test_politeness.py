import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import politeness

EPOCH = dt.datetime(2024, 1, 1)


def brute_force(times, period):
    """The admission rule for one domain, one arrival at a time."""
    out, last = [], None
    for t in times:
        ok = last is None or t - last >= period
        out.append(ok)
        last = t if ok else last
    return out


def arrivals(spark, rows):
    """rows: (domain, seconds)"""
    data = [(i, d, f"u{i}", EPOCH + dt.timedelta(seconds=s)) for i, (d, s) in enumerate(rows)]
    return spark.createDataFrame(data, "arrival_id long, domain string, url string, ts timestamp_ntz")


def expected(rows, period):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], f"u{i}", i))
    admitted, slots, last, slot = {}, {}, {}, {}
    for i in order:
        domain, at = rows[i]
        admitted[i] = domain not in last or at - last[domain] >= period
        if admitted[i]:
            last[domain] = at
        slot[domain] = at if domain not in slot else max(at, slot[domain] + period)
        slots[i] = slot[domain]
    return admitted, slots


def uniform(seed, n, span, domains=("hot", "a", "b")):
    rng = random.Random(seed)
    weights = [8] + [1] * (len(domains) - 1)
    return [(rng.choices(domains, weights)[0], rng.randrange(span)) for _ in range(n)]


CASES = {
    "boundaries": [("d", 0), ("d", 29), ("d", 30), ("d", 31), ("e", 5), ("d", 61)],
    "hot domain over many blocks": uniform(1, 3000, 100_000),
    "dense arrivals that never fall into step": [("hot", i) for i in range(0, 3000)],
    "all at once": [("hot", 7)] * 500 + [("b", 7)],
    "one long burst within a period": [("hot", i % 20) for i in range(400)] + [("hot", 1000)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("count", [1, 9])
def test_against_one_by_one(spark, name, count):
    rows = CASES[name]
    admitted, slots = expected(rows, 30)
    df = arrivals(spark, rows)
    got = {r.arrival_id: r.admitted for r in politeness.admit(df, 30, count).collect()}
    assert got == admitted
    start = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp())
    planned = politeness.schedule(df, 30, count).select(
        "arrival_id", (F.unix_micros("slot") / 1_000_000 - start).cast("long").alias("slot")
    )
    assert {r.arrival_id: r.slot for r in planned.collect()} == slots


def test_several_levels(spark, monkeypatch):
    monkeypatch.setattr(politeness, "FAN_IN", 2)
    rows = [("hot", i) for i in range(1000)] + [("hotter", i) for i in range(0, 2000, 7)] + [("c", 5)]
    for period in (1, 31, 700, 5000):
        got = {r.arrival_id: r.admitted for r in politeness.admit(arrivals(spark, rows), period, 11).collect()}
        assert got == expected(rows, period)[0]


def test_late_arrivals_of_a_known_domain(spark):
    """Arrivals in several blocks before, around and after the admission known from earlier batches."""
    rows = [("d", i) for i in range(0, 400, 3)]
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp())
    earlier = spark.createDataFrame([("d", (base + 200) * 1_000_000)], "domain string, since long")
    got = politeness.admit(arrivals(spark, rows), 30, 5, earlier).filter("admitted").collect()
    want, last = [], 200
    for i, (_, at) in enumerate(rows):
        if at - last >= 30:
            want.append(i)
            last = at
    assert sorted(r.arrival_id for r in got) == want


def test_steps_stand_for_their_arrivals():
    rng = np.random.default_rng(4)
    for _ in range(200):
        period = int(rng.integers(1, 40))
        parts = [np.sort(rng.integers(100 * i, 100 * i + 100, int(rng.integers(1, 30)))) for i in range(4)]
        whole = np.concatenate(parts)
        before = int(rng.integers(-50, whole[0] + 1))
        bound = int(whole[0]) + period
        steps = [politeness.transfer(p, period, int(p[0]) + period) for p in parts]
        t, v = politeness.composed(steps, period, bound)
        assert (t[:-1] < bound).all()
        _, last = politeness.admitted_positions(whole, period, before)
        assert politeness._after((t, v), np.asarray([before]), period)[0] == last


def test_earlier_admissions_count(spark):
    rows = [("d", 10), ("d", 40), ("e", 10)]
    since = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    earlier = spark.createDataFrame([("d", since)], "domain string, since long")
    got = politeness.admit(arrivals(spark, rows), 30, earlier=earlier).collect()
    assert {r.arrival_id: r.admitted for r in got} == {0: False, 1: True, 2: True}


def test_blocks_are_balanced_for_one_domain(spark):
    sizes = [
        r["count"] for r in politeness.blocks(arrivals(spark, uniform(2, 4000, 10**6, ("hot",))), 8).groupBy("block").count().collect()
    ]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_positions_match_brute_force():
    rng = np.random.default_rng(3)
    for period in (1, 5, 50):
        ts = np.sort(rng.integers(0, 1000, 300))
        flags, last = politeness.admitted_positions(ts, period, None)
        assert flags.tolist() == brute_force(ts.tolist(), period)
        assert last == ts[flags][-1]
