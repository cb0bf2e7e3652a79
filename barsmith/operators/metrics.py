"""What a list of numbered trades amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators.blocks import BLOCK, running
from barsmith.operators.quantiles import median

START, LEAST_SAMPLE = 100.0, 20


def equity_curve(trades: DataFrame) -> DataFrame:
    """(trade_number, time, equity, drawdown), each rounded to six digits. Running values go by blocks of trades."""
    rows = trades.select("trade_number", F.col("exit_time").alias("time"), "net_return", F.lit(0).alias("_all"))
    block = F.floor((F.col("trade_number") - 1) / BLOCK)
    rows = running(rows, ["_all"], block, ["trade_number"], {"_e": ("product", 1 + F.col("net_return") / 100)}).withColumn("_e", START * F.col("_e"))
    rows = running(rows, ["_all"], block, ["trade_number"], {"_peak": ("max", F.greatest(F.lit(START), F.col("_e")))})
    drawdown = F.when(F.col("_peak") > 0, (F.col("_e") - F.col("_peak")) / F.col("_peak") * 100).otherwise(0.0)
    return rows.select("trade_number", "time", F.round("_e", 6).alias("equity"), F.round(drawdown, 6).alias("drawdown"))


def maximum_drawdown(curve: DataFrame) -> DataFrame:
    return curve.agg(F.abs(F.coalesce(F.min(F.least("drawdown", F.lit(0.0))), F.lit(0.0))).alias("maximum_drawdown"))


def streaks(trades: DataFrame) -> DataFrame:
    """One row: the longest runs of winning and of losing trades; a trade that breaks even ends both."""
    rows = trades.select("trade_number", F.signum("net_return").cast("int").alias("s"))
    block = F.floor((F.col("trade_number") - 1) / BLOCK)
    rows = running(rows, ["s"], block, ["trade_number"], {"_k": ("sum", F.lit(1))}).withColumn("_run", F.col("trade_number") - F.col("_k"))
    runs = rows.groupBy("s", "_run").agg(F.count(F.lit(1)).alias("n"))
    most = lambda s: F.coalesce(F.max(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).cast("bigint")
    return runs.agg(most(1).alias("longest_winning_streak"), most(-1).alias("longest_losing_streak"))


def summary(trades: DataFrame, total_matches: int | None = None, skipped: int | None = None) -> DataFrame:
    """One row of figures about executed, numbered trades, rounded to four digits (holding bars to two).

    ``trades`` are read several times, so they should be a table; the median of returns is found by jobs of its own.
    """
    middle = median(trades, "net_return")
    net = F.col("net_return")
    win, lose = net > 0, net < 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = trades.agg(
        F.count(F.lit(1)).alias("trades_executed"), F.count_if(win).alias("wins"), F.count_if(lose).alias("losses"), F.count_if(net == 0).alias("breakeven"), F.count_if(F.col("exit_reason") == "timeout").alias("timeouts"),
        F.product(1 + F.col("gross_return") / 100).alias("_g"), F.avg(net).alias("_avg"), F.lit(middle).cast("double").alias("_mid"), zero(F.avg(F.when(win, net))).alias("_w"), zero(F.avg(F.when(lose, net))).alias("_l"),
        zero(F.sum(F.when(win, net))).alias("_gp"), F.abs(zero(F.sum(F.when(lose, net)))).alias("_gl"), F.avg("holding_bars").alias("_hold"), F.count_if(F.coalesce("same_bar_ambiguity", F.lit(False))).alias("same_bar_ambiguity_count"),
    )
    curve = equity_curve(trades)
    end = curve.agg(F.max_by("equity", "trade_number").alias("_end"), F.min(F.least("drawdown", F.lit(0.0))).alias("_dd"))
    rows = each.crossJoin(F.broadcast(end)).crossJoin(F.broadcast(streaks(trades)))  # one row each
    n = F.col("trades_executed")
    rate = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    r4 = lambda c: F.round(zero(c), 4)
    warning = F.when(n == 0, "no trades").when(n < LEAST_SAMPLE, F.concat(F.lit("only "), n.cast("string"), F.lit(" trades")))
    counts = [F.lit(total_matches).cast("bigint").alias("total_matches"), F.lit(skipped).cast("bigint").alias("skipped_matches")] if total_matches is not None else []
    return rows.select(
        *counts, "trades_executed", "wins", "losses", "breakeven", "timeouts", r4(rate("wins") * 100).alias("win_rate"), r4(F.col("_g") * 100 - 100).alias("gross_return"), r4(F.col("_end") - START).alias("net_return"), r4(F.col("_avg")).alias("average_return"), r4(F.col("_mid")).alias("median_return"),
        r4(F.col("_w")).alias("average_winner"), r4(F.col("_l")).alias("average_loser"), r4(F.when(F.col("_l") != 0, F.abs(F.col("_w") / F.col("_l"))).otherwise(0.0)).alias("risk_reward_achieved"), r4(rate("wins") * F.col("_w") + rate("losses") * F.col("_l")).alias("expectancy"),
        F.round(F.when(F.col("_gl") > 0, F.col("_gp") / F.col("_gl")), 4).alias("profit_factor"), r4(F.abs(zero(F.col("_dd")))).alias("maximum_drawdown"), "longest_winning_streak", "longest_losing_streak", F.round(zero(F.col("_hold")), 2).alias("average_holding_bars"), warning.alias("sample_size_warning"), "same_bar_ambiguity_count",
    )
