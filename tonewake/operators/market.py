"""Event windows, market-adjusted and beta-adjusted cumulative abnormal returns, over a long price table.

prices: ticker, day, close.  The calendar numbers the benchmark's and all tickers' trading days; an event meets its first
trading day by an equi join on civil days, and lookbacks are differences of running sums, so there is no range join.  What is
broadcast has a row for each trading or civil day: a few thousand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (1, 3, 5)
LOOKBACK = 120
MIN_BETA_DAYS = 30


def calendar(prices: DataFrame) -> DataFrame:
    """day, pos: days with at least one close, numbered from 0.  A row for each trading day, a few thousand at most."""
    days = prices.where("close is not null").select("day").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("day")) - 1)


def next_positions(cal: DataFrame) -> DataFrame:
    """For each civil day up to the last trading day: the first position on or after it, and after it."""
    following = F.lead("day").over(Window.orderBy("day"))
    spans = cal.withColumn("__next", following).withColumn("__last", F.max("pos").over(Window.partitionBy(F.lit(1))))
    civil = spans.select("pos", "day", F.explode(F.sequence("day", F.coalesce(F.date_sub("__next", 1), "day"))).alias("civil"), F.col("__last"))
    on = F.when(F.col("civil") == F.col("day"), F.col("pos")).otherwise(F.col("pos") + 1)
    return civil.select("civil", on.alias("on_or_after"), F.when(F.col("pos") < F.col("__last"), F.col("pos") + 1).alias("after"), F.col("__last").alias("last_pos"))


def with_start(events: DataFrame, cal: DataFrame) -> DataFrame:
    """events (ticker, date, after_close) with start_pos and last_pos; null where no trading day follows."""
    table = next_positions(cal)
    ends = cal.agg(F.min("day").alias("__first"), F.max("pos").alias("__last"))
    matched = events.join(F.broadcast(table), events["date"] == table["civil"], "left").crossJoin(F.broadcast(ends))  # one row
    early = F.col("date") < F.col("__first")
    start = F.when(early, 0).when(F.col("after_close"), F.col("after")).otherwise(F.col("on_or_after"))
    return matched.select(*events.columns, start.alias("start_pos"), F.col("__last").alias("last_pos"))


def event_windows(started: DataFrame, windows=WINDOWS) -> DataFrame:
    """Adds window_Wd: the positions of each window's days; empty where it runs beyond the calendar, null without a start."""
    out = started
    for w in windows:
        inside = F.col("start_pos") + w - 1 <= F.col("last_pos")
        out = out.withColumn(f"window_{w}d", F.when(F.col("start_pos").isNull(), F.lit(None)).when(inside, F.sequence(F.col("start_pos"), F.col("start_pos") + w - 1)).otherwise(F.array().cast("array<int>")))
    return out


def daily_returns(prices: DataFrame, cal: DataFrame, benchmark: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """ticker, pos, close, market, stock_return, market_return: returns from the calendar's day before, null where a price is.

    A row for each trading day from a ticker's first price to lookback days after its last, so that a missing price is seen as
    one and a lookback that ends later finds its days.  All joins are by equality; each ticker makes its own days."""
    days = cal.join(benchmark.select("day", F.col("close").alias("market")), "day", "left")
    at = F.broadcast(days.select("day", "pos"))  # a row for each trading day
    own = prices.join(at, "day").select("ticker", "pos", "close")
    ends = own.groupBy("ticker").agg(F.min("pos").alias("__first"), F.max("pos").alias("__until")).crossJoin(F.broadcast(cal.agg(F.max("pos").alias("__last"))))  # one row
    grid = ends.select("ticker", F.explode(F.sequence("__first", F.least(F.col("__until") + lookback + 1, F.col("__last")))).alias("pos"))
    dense = grid.join(F.broadcast(days.select("pos", "market")), "pos").join(own, ["ticker", "pos"], "left")
    before = Window.partitionBy("ticker").orderBy("pos")
    last_close, last_market = F.lag("close").over(before), F.lag("market").over(before)
    return dense.select("ticker", "pos", "close", "market", F.try_divide(F.col("close") - last_close, last_close).alias("stock_return"), F.try_divide(F.col("market") - last_market, last_market).alias("market_return"))


def abnormal_returns(started: DataFrame, daily: DataFrame, windows=WINDOWS) -> DataFrame:
    """Adds CAR_Wd, the window's sum of stock less market returns; null where any is missing."""
    ahead = Window.partitionBy("ticker").orderBy("pos")
    ar = F.col("stock_return") - F.col("market_return")
    cols = []
    for w in windows:
        frame = ahead.rowsBetween(0, w - 1)
        cols.append(F.when(F.count(ar).over(frame) == w, F.sum(ar).over(frame)).alias(f"CAR_{w}d"))
    cars = daily.select("ticker", F.col("pos").alias("start_pos"), *cols)
    return started.join(cars, ["ticker", "start_pos"], "left")


def betas(daily: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """ticker, start_pos, beta for every position that has one: the slope of stock on market returns over the lookback before it.

    Returns are between days that both have prices, so they may span gaps; fewer than MIN_BETA_DAYS such days give none.

    Running sums over a ticker's days give every lookback's moments as a difference of two rows, so no event meets its days:
    the sums up to the last day, less those up to the lookback's first day with both prices, whose own return reaches
    further back.  Sums are of returns less nothing, a few thousand terms at most, so the differences keep their digits."""
    of_ticker = Window.partitionBy("ticker")
    forward, backward = of_ticker.orderBy("pos"), of_ticker.orderBy(F.col("pos").desc())
    both = F.col("close").isNotNull() & F.col("market").isNotNull()
    marked = daily.select("ticker", "pos", *[F.when(both, F.col(c)).alias(f"__{c}") for c in ("close", "market")])
    earlier = {c: F.last(f"__{c}", ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, -1)) for c in ("close", "market")}
    steps = marked.select("ticker", "pos", F.col("__close").isNotNull().alias("__both"), *[F.when(F.col(f"__{c}").isNotNull(), F.try_divide(F.col(f"__{c}") - earlier[c], earlier[c])).alias(f"__{k}") for k, c in (("s", "close"), ("m", "market"))])
    pair = F.col("__s").isNotNull() & F.col("__m").isNotNull()
    terms = {"days": F.col("__both").cast("double"), "n": pair.cast("double"), "s": F.col("__s"), "m": F.col("__m"), "sm": F.col("__s") * F.col("__m"), "mm": F.col("__m") * F.col("__m")}
    running = steps.select("ticker", "pos", "__both", F.struct(*[F.sum(F.when(F.col("__both") if k == "days" else pair, v).otherwise(0.0)).over(forward).alias(k) for k, v in terms.items()]).alias("__to"))
    ahead = running.withColumn("__from", F.last(F.when(F.col("__both"), F.struct("pos", "__to")), ignorenulls=True).over(backward))
    span = ahead.withColumn("__first", F.lag("__from", lookback).over(forward)).where((F.col("pos") - lookback >= 1) & (F.col("__first.pos") <= F.col("pos")))
    # lookbacks that begin before the ticker's first row begin at that row
    opening = F.first("__from").over(forward)
    early = ahead.withColumn("__first", opening).withColumn("__row", F.row_number().over(forward)).where((F.col("__row") <= lookback) & (F.col("pos") - lookback >= 1)).drop("__row")
    sums = {k: F.col(f"__to.{k}") - F.col(f"__first.__to.{k}") for k in terms}
    all_spans = span.unionByName(early).select("ticker", (F.col("pos") + 1).alias("start_pos"), *[v.alias(k) for k, v in sums.items()])
    slope = F.try_divide(F.col("sm") - F.col("s") * F.col("m") / F.col("n"), F.col("mm") - F.col("m") * F.col("m") / F.col("n"))
    return all_spans.where(F.col("days") + 1 >= MIN_BETA_DAYS).select("ticker", "start_pos", slope.alias("beta"))


def beta_abnormal_returns(started: DataFrame, daily: DataFrame, lookback: int = LOOKBACK, windows=WINDOWS) -> DataFrame:
    """Adds beta (4 decimals) and beta_CAR_Wd, the sums of stock less beta times market returns."""
    ahead = Window.partitionBy("ticker").orderBy("pos")
    complete = F.when(F.col("stock_return").isNotNull() & F.col("market_return").isNotNull(), 1)
    cols = []
    for w in windows:
        frame = ahead.rowsBetween(0, w - 1)
        whole = F.count(complete).over(frame) == w
        cols += [F.when(whole, F.sum("stock_return").over(frame)).alias(f"__s{w}"), F.when(whole, F.sum("market_return").over(frame)).alias(f"__m{w}")]
    sums = daily.select("ticker", F.col("pos").alias("start_pos"), *cols)
    reaches = F.col("start_pos") + min(windows) - 1 <= F.col("last_pos")
    table = sums.join(betas(daily, lookback), ["ticker", "start_pos"], "full")
    joined = started.join(table, ["ticker", "start_pos"], "left").withColumn("beta", F.when(reaches, F.col("beta")))
    out = reduce(lambda d, w: d.withColumn(f"beta_CAR_{w}d", F.col(f"__s{w}") - F.col("beta") * F.col(f"__m{w}")), windows, joined)
    return out.withColumn("beta", F.round("beta", 4)).drop(*[f"__{k}{w}" for k in "sm" for w in windows])
