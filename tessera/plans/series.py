"""Daily bars per event type, indicators, rules and replay."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import timeseries as T
from tessera.registry import query
from tessera.tables import table

BARS = """bars AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""
def by():
    """The order of a type's bars."""
    return Window.partitionBy("k").orderBy("d")



def bars(spark, sf_dir) -> DataFrame:
    at = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("d")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


@query("w17_sma_and_rolling", f"""WITH {BARS} SELECT k, d, round(CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END, 6) AS sma, round(CASE WHEN count(close) OVER w = 5 THEN stddev_samp(close) OVER w END, 6) AS sd, CASE WHEN count(close) OVER w = 5 THEN max(close) OVER w END AS top FROM bars WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w17(spark, sf_dir):
    c = F.col("close")
    return bars(spark, sf_dir).select("k", "d", F.round(T.sma(c, by(), 5), 6).alias("sma"), F.round(T.rolling(c, by(), 5, F.stddev_samp), 6).alias("sd"), T.rolling(c, by(), 5, F.max).alias("top"))


@query("w18_ema", f"""WITH RECURSIVE {BARS}, n AS (SELECT k, d, close, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM bars),
       e AS (SELECT k, d, i, close::DOUBLE AS y FROM n WHERE i = 1 UNION ALL SELECT n.k, n.d, n.i, 2.0::DOUBLE / 9 * n.close + (1 - 2.0::DOUBLE / 9) * e.y FROM n JOIN e ON n.k = e.k AND n.i = e.i + 1) SELECT k, d, round(y, 6) AS ema FROM e""")
def w18(spark, sf_dir):
    return T.with_ema(bars(spark, sf_dir), "k", "d", "close", 8, "ema").select("k", "d", F.round("ema", 6).alias("ema"))


@query("w19_rsi", f"""WITH {BARS}, x AS (SELECT k, d, coalesce(close - lag(close) OVER (PARTITION BY k ORDER BY d), 0) AS c FROM bars), g AS (SELECT k, d, count(*) OVER w AS n, avg(greatest(c, 0)) OVER w AS g, avg(greatest(-c, 0)) OVER w AS l FROM x WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
       SELECT k, d, round(CASE WHEN n < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 'NaN'::DOUBLE END, 5) AS rsi FROM g""")
def w19(spark, sf_dir):
    return T.with_rsi(bars(spark, sf_dir), "close", by()).select("k", "d", F.round("rsi", 5).alias("rsi"))


@query("w20_bollinger", f"""WITH {BARS}, b AS (SELECT k, d, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS m, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(close) OVER w END AS s FROM bars WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
       SELECT k, d, round(m - 2 * s, 6) AS lower, round(m, 6) AS middle, round(m + 2 * s, 6) AS upper, round(4 * s / m, 6) AS width FROM b""")
def w20(spark, sf_dir):
    lo, mid, up = T.bollinger(F.col("close"), by())
    return bars(spark, sf_dir).select("k", "d", F.round(lo, 6).alias("lower"), F.round(mid, 6).alias("middle"), F.round(up, 6).alias("upper"), F.round((up - lo) / mid, 6).alias("width"))


@query("w21_atr", f"""WITH {BARS}, t AS (SELECT k, d, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY k ORDER BY d)), abs(low - lag(close) OVER (PARTITION BY k ORDER BY d))) AS tr FROM bars)
       SELECT k, d, round(CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END, 6) AS atr FROM t WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def w21(spark, sf_dir):
    return T.with_atr(bars(spark, sf_dir), by()).select("k", "d", F.round("atr", 6).alias("atr"))


@query("w22_percent_change", f"WITH {BARS} SELECT k, d, round(100 * (close / nullif(lag(close, 3) OVER (PARTITION BY k ORDER BY d), 0) - 1), 4) AS momentum FROM bars")
def w22(spark, sf_dir):
    return bars(spark, sf_dir).select("k", "d", F.round(100 * (F.col("close") / F.nullif(F.lag("close", 3).over(by()), F.lit(0.0)) - 1), 4).alias("momentum"))


@query("w24_crossovers", f"""WITH {BARS}, m AS (SELECT k, d, avg(close) OVER (PARTITION BY k ORDER BY d ROWS 2 PRECEDING) - avg(close) OVER (PARTITION BY k ORDER BY d ROWS 6 PRECEDING) AS x FROM bars), l AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY d) AS b FROM m)
       SELECT k, d, CASE WHEN x > 1e-9 THEN 'golden' ELSE 'death' END AS cross_kind FROM l WHERE (x > 1e-9 AND b <= 1e-9) OR (x < -1e-9 AND b >= -1e-9)""")
def w24(spark, sf_dir):
    c = F.col("close")
    x = bars(spark, sf_dir).withColumn("x", F.avg(c).over(by().rowsBetween(-2, 0)) - F.avg(c).over(by().rowsBetween(-6, 0))).withColumn("b", F.lag("x").over(by()))
    return x.filter("(x > 1e-9 AND b <= 1e-9) OR (x < -1e-9 AND b >= -1e-9)").select("k", "d", F.when(F.col("x") > 1e-9, "golden").otherwise("death").alias("cross_kind"))


@query("d21_bollinger_rule", f"""WITH {BARS}, b AS (SELECT k, d, close, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS m, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(close) OVER w END AS s FROM bars WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
       SELECT k, d, CASE WHEN close <= (m - 2 * s) * 1.01 THEN 1 WHEN close >= (m + 2 * s) * 0.99 THEN -1 ELSE 0 END AS signal FROM b""")
def d21(spark, sf_dir):
    lo, _, up = T.bollinger(F.col("close"), by())
    return bars(spark, sf_dir).select("k", "d", F.when(F.col("close") <= lo * 1.01, 1).when(F.col("close") >= up * 0.99, -1).otherwise(0).alias("signal"))


def _signals(spark, sf_dir):
    c = F.col("close")
    return bars(spark, sf_dir).withColumn("signal", F.when(c > F.avg(c).over(by().rowsBetween(-4, 0)), 1).otherwise(-1))


@query("d22_backtest", f"""WITH RECURSIVE {BARS}, g AS (SELECT k, d, close AS p, CASE WHEN close > avg(close) OVER (PARTITION BY k ORDER BY d ROWS 4 PRECEDING) THEN 1 ELSE -1 END AS s, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM bars),
       r AS (SELECT k, 0::BIGINT AS i, NULL::DATE AS d, 0.0::DOUBLE AS p, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS held, 0.0::DOUBLE AS entry, 0::BIGINT AS trades FROM (SELECT DISTINCT k FROM bars)
             UNION ALL SELECT g.k, g.i, g.d, g.p, CASE WHEN r.held > 0 AND (g.p <= r.entry * (1 - 0.05::DOUBLE) OR g.p >= r.entry * (1 + 0.1::DOUBLE) OR g.s < 0) THEN r.held * g.p * (1 - 0.0005::DOUBLE) * (1 - 0.001::DOUBLE) WHEN r.held = 0 AND g.s > 0 AND g.p > 0 THEN 0 ELSE r.cash END,
                    CASE WHEN r.held > 0 AND (g.p <= r.entry * (1 - 0.05::DOUBLE) OR g.p >= r.entry * (1 + 0.1::DOUBLE) OR g.s < 0) THEN 0 WHEN r.held = 0 AND g.s > 0 AND g.p > 0 THEN r.cash * (1 - 0.001::DOUBLE) / (g.p * (1 + 0.0005::DOUBLE)) ELSE r.held END,
                    CASE WHEN r.held = 0 AND g.s > 0 AND g.p > 0 THEN g.p * (1 + 0.0005::DOUBLE) ELSE r.entry END, r.trades + CASE WHEN r.held > 0 AND (g.p <= r.entry * (1 - 0.05::DOUBLE) OR g.p >= r.entry * (1 + 0.1::DOUBLE) OR g.s < 0) THEN 1 ELSE 0 END FROM r JOIN g ON g.k = r.k AND g.i = r.i + 1)
       SELECT k, d, round(cash + held * p, 6) AS equity, trades, round(held, 6) AS position FROM r WHERE i > 0""")
def d22(spark, sf_dir):
    return T.backtest(_signals(spark, sf_dir), "k", "d", "close", "signal").withColumns({c: F.round(c, 6) for c in ("equity", "position")})


@query("d23_metrics", f"""WITH {BARS}, r AS (SELECT k, d, close + 1 AS v, (close + 1) / lag(close + 1) OVER w - 1 AS r, max(close + 1) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM bars WINDOW w AS (PARTITION BY k ORDER BY d))
       SELECT k, round(arg_max(v, d) / arg_min(v, d) - 1, 6) AS total_return, round(sqrt(252) * avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe, round(sqrt(252) * avg(r) / nullif(stddev_samp(r) FILTER (r < 0), 0), 6) AS sortino, round(max((p - v) / p), 6) AS max_drawdown FROM r GROUP BY k""")
def d23(spark, sf_dir):
    m = T.metrics(bars(spark, sf_dir).select("k", "d", (F.col("close") + 1).alias("equity")), "k", "d")
    return m.select("k", *(F.round(c, 6).alias(c) for c in ("total_return", "sharpe", "sortino", "max_drawdown")))


@query("d24_position_size", "SELECT event_id, round(least(200 / greatest(value, 1), 100, 9500 / greatest(value, 1)), 6) AS size FROM events")
def d24(spark, sf_dir):
    v = F.greatest("value", F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.least(200 / v, F.lit(100.0), 9500 / v), 6).alias("size"))


@query("d25_trailing_stop", f"WITH {BARS} SELECT k, d, round(0.98 * max(close) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS stop FROM bars")
def d25(spark, sf_dir):
    return bars(spark, sf_dir).select("k", "d", F.round(0.98 * F.max("close").over(by().rowsBetween(Window.unboundedPreceding, 0)), 6).alias("stop"))


@query("d26_buy_and_hold", f"WITH {BARS} SELECT k, date_trunc('week', d)::DATE AS week, round(arg_max(close, d) / nullif(arg_min(close, d), 0) - 1, 6) AS ret FROM bars GROUP BY 1, 2")
def d26(spark, sf_dir):
    b = bars(spark, sf_dir).groupBy("k", F.trunc("d", "week").alias("week")).agg(F.max_by("close", "d").alias("e"), F.min_by("close", "d").alias("s"))
    return b.select("k", "week", F.round(F.col("e") / F.nullif("s", F.lit(0.0)) - 1, 6).alias("ret"))
