"""Indicators over ordered series, trading rules and a bar-by-bar replay."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def rolling(value: Column, w: WindowSpec, n: int, how=F.avg) -> Column:
    """``how`` over the last n rows; null until there are n."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, how(value).over(frame))


def sma(value: Column, w: WindowSpec, n: int) -> Column:
    return rolling(value, w, n)


def bollinger(value: Column, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Lower, middle and upper band."""
    m, s = rolling(value, w, n), rolling(value, w, n, F.stddev_samp)
    return m - k * s, m, m + k * s


def with_rsi(df: DataFrame, value: str, w: WindowSpec, n: int = 14) -> DataFrame:
    """Adds the relative strength index by simple rolling means; the first difference counts as 0, NaN where nothing moved."""
    d = df.withColumn("_d", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))
    gain, loss = rolling(F.greatest("_d", F.lit(0.0)), w, n), rolling(F.greatest(-F.col("_d"), F.lit(0.0)), w, n)
    return d.withColumn("rsi", F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, F.lit(100.0)).when(gain == 0, F.lit(float("nan")))).drop("_d")


def with_atr(df: DataFrame, w: WindowSpec, n: int = 14, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    before = F.lag(close).over(w)
    tr = F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))
    d = df.withColumn("_tr", tr)
    return d.withColumn("atr", rolling(F.col("_tr"), w, n)).drop("_tr")


def with_ema(df: DataFrame, key: str, order: str, value: str, span: int, name: str) -> DataFrame:
    """Adds the exponential mean per key. The recurrence needs a key's series in order: it is folded in one pass over sorted rows."""

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator) -> Iterator:
        last_key, y, a = None, None, 2 / (span + 1)
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[value], strict=True):
                y = x if k != last_key or y is None else a * x + (1 - a) * y
                last_key = k
                out.append(y)
            yield pdf.assign(**{name: out})

    sorted_ = df.repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in kinds.items()) + f", {name} double")


def backtest(bars: DataFrame, key: str, order: str, price: str, signal: str, capital: float = 10_000.0, slip: float = 0.0005, fee: float = 0.001, stop: float = 0.05, target: float = 0.1) -> DataFrame:
    """Replays each key's bars: key, order, equity, trades, position.

    ``signal`` is 1 to buy with all cash, -1 to sell. A held position is closed by its stop before its target before
    the signal; an open one is valued at the bar's price. State is carried over a key's sorted rows, so a key's bars
    are read in one task in order and are not gathered in memory.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        last = None
        for pdf in batches:
            rows = []
            for k, t, p, s in zip(pdf[key], pdf[order], pdf[price], pdf[signal], strict=True):
                if k != last:
                    last, cash, held, entry, trades = k, capital, 0.0, 0.0, 0
                if held and (p <= entry * (1 - stop) or p >= entry * (1 + target) or s < 0):
                    cash, held, trades = held * p * (1 - slip) * (1 - fee), 0.0, trades + 1
                elif not held and s > 0 and p > 0:
                    entry = p * (1 + slip)
                    held, cash = cash * (1 - fee) / entry, 0.0
                rows.append((k, t, cash + held * p, trades, held))
            yield pd.DataFrame(rows, columns=[key, order, "equity", "trades", "position"])

    k, t = (bars.schema[c].dataType.simpleString() for c in (key, order))
    return bars.select(key, order, price, signal).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {k}, {order} {t}, equity double, trades long, position double")


def metrics(equity: DataFrame, key: str, order: str, value: str = "equity") -> DataFrame:
    """Per key: total_return, sharpe and sortino (per-bar, times the root of 252), max_drawdown."""
    w = Window.partitionBy(key).orderBy(order)
    d = equity.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_p", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    root = F.sqrt(F.lit(252.0))
    return d.groupBy(key).agg(
        (F.max_by(value, order) / F.min_by(value, order) - 1).alias("total_return"),
        (root * F.avg("_r") / F.nullif(F.stddev_samp("_r"), F.lit(0.0))).alias("sharpe"),
        (root * F.avg("_r") / F.nullif(F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))), F.lit(0.0))).alias("sortino"),
        F.max((F.col("_p") - F.col(value)) / F.col("_p")).alias("max_drawdown"),
    )
