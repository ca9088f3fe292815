"""Event windows and abnormal returns, on hand-computed prices."""

import datetime as dt
import random

import pytest

from tonewake.operators import market

DAYS = [dt.date(2020, 1, d) for d in (6, 7, 8, 9, 10, 13, 14, 15)]
STOCK, SPY = [100.0] + [110.0] * 7, [200.0] + [202.0] * 7


def prices(spark, **series):
    return spark.createDataFrame([(t, d, v) for t, vs in series.items() for d, v in zip(DAYS, vs, strict=True)], "ticker string, day date, close double")


def started(spark, p, *events):
    df = spark.createDataFrame(list(events), "ticker string, date date, after_close boolean")
    return market.with_start(df, market.calendar(p))


def window(spark, day, after, w):
    r = market.event_windows(started(spark, prices(spark, TEST=STOCK), ("TEST", day, after))).first()
    positions = r[f"window_{w}d"]
    return None if positions is None else [DAYS[i] for i in positions]


@pytest.mark.parametrize(
    ("day", "after", "first"),
    [(dt.date(2020, 1, 7), False, 1), (dt.date(2020, 1, 7), True, 2), (dt.date(2020, 1, 10), True, 5), (dt.date(2020, 1, 11), False, 5), (dt.date(2020, 1, 11), True, 5), (dt.date(2020, 1, 1), False, 0), (dt.date(2020, 1, 15), False, 7)],
)
def test_first_day(spark, day, after, first):
    assert window(spark, day, after, 1) == [DAYS[first]]


def test_windows(spark):
    for w in (1, 3, 5):
        assert window(spark, dt.date(2020, 1, 7), False, w) == DAYS[1 : 1 + w]
    assert window(spark, dt.date(2020, 1, 15), False, 5) == []
    assert window(spark, dt.date(2020, 1, 15), True, 1) is None
    assert window(spark, dt.date(2020, 2, 1), False, 1) is None


def cars(spark, p, benchmark, day, ticker="TEST"):
    s = started(spark, p, (ticker, day, False))
    daily = market.daily_returns(p, market.calendar(p), benchmark.select("day", "close"))
    return market.abnormal_returns(s, daily).select("CAR_1d", "CAR_3d", "CAR_5d").first()


def test_car(spark):
    spy = prices(spark, SPY=SPY)
    assert list(cars(spark, prices(spark, TEST=STOCK, SPY=SPY), spy, DAYS[1])) == pytest.approx([0.09] * 3)
    assert cars(spark, prices(spark, TEST=[100.0] + [90.0] * 7), spy, DAYS[1])[0] == pytest.approx(-0.11)
    assert list(cars(spark, spy, spy, DAYS[1], "SPY")) == pytest.approx([0.0] * 3)


def test_car_is_null(spark):
    spy, p = prices(spark, SPY=SPY), prices(spark, TEST=STOCK)
    assert tuple(cars(spark, p, spy, DAYS[1], "NONE")) == (None,) * 3
    assert tuple(cars(spark, p, spy, DAYS[0])) == (None,) * 3
    gap = prices(spark, TEST=[100.0, 110.0, 110.0, None] + [110.0] * 4, SPY=SPY)
    assert cars(spark, gap, spy, DAYS[1])[0] == pytest.approx(0.09) and cars(spark, gap, spy, DAYS[1])[1] is None
    zero = prices(spark, TEST=[0.0] + [110.0] * 7, SPY=SPY)
    assert cars(spark, zero, spy, DAYS[1])[0] is None


def walk(n, seed, miss=()):
    rng, out, x = random.Random(seed), [], 100.0
    for i in range(n):
        x *= 1 + rng.gauss(0.0005, 0.01)
        out.append(None if i in miss else x)
    return out


def test_beta(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(160)]
    spy, own = walk(160, 42), walk(160, 7, miss={100, 101, 120})
    rows = [("SPY", d, v) for d, v in zip(days, spy, strict=True)] + [("OWN", d, v) for d, v in zip(days, own, strict=True)]
    p = spark.createDataFrame(rows, "ticker string, day date, close double")
    bench = p.where("ticker = 'SPY'").select("day", "close")
    s = started(spark, p, ("SPY", days[150], False), ("OWN", days[150], False), ("OWN", days[100], False), ("NONE", days[150], False))
    daily = market.daily_returns(p, market.calendar(p), bench)
    got = {(r["ticker"], r["start_pos"]): r for r in market.beta_abnormal_returns(s, daily, lookback=120).collect()}
    assert got["SPY", 150]["beta"] == pytest.approx(1, rel=1e-3) and got["SPY", 150]["beta_CAR_5d"] == pytest.approx(0, abs=1e-9)
    both = [(a, b) for a, b in zip(own[29:150], spy[29:150], strict=True) if a is not None]
    x = [(b[0] / a[0] - 1, b[1] / a[1] - 1) for a, b in zip(both, both[1:], strict=False)]
    ms, mm = sum(a for a, _ in x) / len(x), sum(b for _, b in x) / len(x)
    beta = sum((a - ms) * (b - mm) for a, b in x) / sum((b - mm) ** 2 for _, b in x)
    assert got["OWN", 150]["beta"] == pytest.approx(beta, abs=1e-4)
    assert got["OWN", 150]["beta_CAR_1d"] == pytest.approx(own[150] / own[149] - 1 - beta * (spy[150] / spy[149] - 1))
    assert got["OWN", 100]["beta"] is None and got["OWN", 100]["beta_CAR_1d"] is None and got["NONE", 150]["beta"] is None


def test_beta_needs_enough_days(spark):
    p = prices(spark, TEST=STOCK, SPY=SPY)
    daily = market.daily_returns(p, market.calendar(p), prices(spark, SPY=SPY).select("day", "close"))
    r = market.beta_abnormal_returns(started(spark, p, ("TEST", DAYS[5], False)), daily).first()
    assert r["beta"] is None and r["beta_CAR_3d"] is None
