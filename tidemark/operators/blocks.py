"""Feature families of short blocks of days and of paths, over a daily frame (``symbol, date, open, high, low, close, volume, ret``).

All are window expressions over one symbol in date order. Undefined values become 0 at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.cleaning import unbiased_moments
from tidemark.operators.families import _done, change, col, mean, std, total, true, zscore


def before(x: str | Column, k: int) -> Column:
    return F.lag(x, k).over(W.ordered())


BLOCKS = [
    *[f"blk_{n}d_{c}" for n in (3, 5) for c in (
        "return consistency pattern_score acceleration reversal_boundary where_extreme front_vs_back range_position max_drawdown recovery_ratio "
        "vol_trend vol_return_agree vol_concentration vwap_vs_close autocorr").split()],
    *[f"blk_boundary_{n}d_{c}" for n in (3, 5) for c in "gap vol_shift streak revert".split()],
    *[f"blk_{c}" for c in (
        "3d_vs_5d_agreement sequential_strength cascade_3_5_10 cascade_5_10_20 cascade_full cascade_break_short cascade_break_long cascade_ratio_3_10 "
        "cascade_ratio_5_20 cascade_vol_expand cascade_vol_compress cascade_return_rank return_roughness 3d_kurtosis 5d_dispersion hurst_proxy").split()],
]


def _levels(n: int) -> Column:
    """The last ``n`` closes against the first of them; null before ``n`` rows, with a missing close, or where the first is 0."""
    closes = [before("close", k) if k else col("close") for k in range(n - 1, -1, -1)]
    known = closes[0] != 0
    for c in closes:
        known = known & c.isNotNull()
    return F.when(known, F.array(*[F.try_divide(c, closes[0]) for c in closes]))


def _running_max(name: str) -> Column:
    return F.transform(name, lambda _, i: F.array_max(F.slice(name, F.lit(1), i + 1)))


def block_structure(rows: DataFrame) -> DataFrame:
    """Patterns within blocks of three and five days, cascades over scales, volume profiles and the seams between blocks.

    A comparison with an undefined sign counts as a difference, in agreements and breaks alike.
    """
    rows = rows.withColumns(
        {
            "volume": col("volume").cast("double"),
            "_n": F.row_number().over(W.ordered()),
            "_way": F.signum("ret"),
            "_size": F.abs("ret"),
            **{f"_r{k}": change("close", k) for k in (3, 5, 10, 20)},
            "_volume_way": F.signum(change("volume")),
        }
    )
    way = {k: F.signum(f"_r{k}") for k in (3, 5, 10, 20)}
    same = lambda a, b: true(way[a] == way[b])
    found: dict[str, Column] = {"_same": true(col("_way") == before("_way", 1)), "_with_volume": true(col("_way") == col("_volume_way"))}
    for n in (3, 5):
        name, back, r = f"blk_{n}d_", range(n - 1, -1, -1), col(f"_r{n}")
        moves = [before("ret", k) if k else col("ret") for k in back]
        sizes = F.array(*[F.abs(m) for m in moves])
        up, down = F.sum(true(col("_way") > 0)).over(W.trailing(n)), F.sum(true(col("_way") < 0)).over(W.trailing(n))
        score = sum((before("_way", k) if k else col("_way")) * (n - k) for k in range(n))
        earlier = before(f"_r{n}", n)
        highest, lowest = F.max("high").over(W.trailing(n)), F.min("low").over(W.trailing(n))
        front = moves[0] if n == 3 else (moves[0] + moves[1]) / 2
        rest = (moves[1] + moves[2]) / 2 if n == 3 else (moves[2] + moves[3] + moves[4]) / 3
        largest = F.array_position(sizes, F.array_max(sizes)) - 1
        sold, valued = F.sum("volume").over(W.trailing(n)) + 1e-10, F.sum(col("close") * col("volume")).over(W.trailing(n))
        seam = before("close", n)
        again = (way[n] == F.signum(earlier)) & (way[n] != 0)
        found |= {
            f"{name}return": r,
            f"{name}consistency": F.greatest(up, down) / n,
            f"{name}pattern_score": score / sum(range(1, n + 1)),
            f"{name}acceleration": moves[2] - moves[0] if n == 3 else (moves[3] + moves[4]) / 2 - (moves[0] + moves[1]) / 2,
            f"{name}reversal_boundary": F.when(earlier.isNotNull(), 1 - true(way[n] == F.signum(earlier))),
            f"{name}where_extreme": F.when(col("_n") >= n, F.coalesce(largest / (n - 1), F.lit(0.5))),
            f"{name}front_vs_back": front - rest,
            f"{name}range_position": (col("close") - lowest) / (highest - lowest + 1e-10),
            f"{name}vol_trend": W.clip((col("volume") - before("volume", n - 1)) / (mean("volume", 20, 5) + 1e-10), -3, 3),
            f"{name}vol_concentration": F.max("volume").over(W.trailing(n)) / sold,
            f"{name}vwap_vs_close": (valued / sold - col("close")) / (col("close") + 1e-10),
            f"blk_boundary_{n}d_gap": (before("open", n - 1) - seam) / (seam + 1e-10),
            f"blk_boundary_{n}d_vol_shift": W.clip(before("volume", n - 1) / (before("volume", n) + 1e-10), 0.1, 10),
            f"blk_boundary_{n}d_revert": zscore("close", 5 * n, 5 if n == 3 else 10),
            f"_restart{n}": F.when(again, None).otherwise(col("_n")),
            f"_earlier{n}": earlier,
            f"_lane{n}": col("_n") % n,
            f"_levels{n}": _levels(n),
        }
    today = col("_size")
    no_more = sum(true((before("_size", k) if k else today) <= today) for k in range(5))
    volumes = [mean("volume", n, 1) for n in (3, 5, 10)]
    over = lambda x: F.when(col(x).isNull() | (col(x) == 0), 1e-10).otherwise(col(x))
    prior = before("_r3", 3)
    found |= {
        "blk_3d_vs_5d_agreement": same(3, 5) * 2 - 1,
        "blk_sequential_strength": W.clip(F.try_divide(col("_r3"), F.when(prior != 0, prior) + 1e-10), -3, 3),
        "blk_cascade_3_5_10": (same(3, 5) + same(5, 10) + same(3, 10)) / 3 * 2 - 1,
        "blk_cascade_5_10_20": (same(5, 10) + same(10, 20) + same(5, 20)) / 3 * 2 - 1,
        "blk_cascade_full": F.when((F.least(*way.values()) > 0) & col("_r20").isNotNull(), 1.0).when((F.greatest(*way.values()) < 0) & col("_r20").isNotNull(), -1.0),
        "blk_cascade_break_short": 1 - same(3, 10),
        "blk_cascade_break_long": 1 - same(10, 20),
        "blk_cascade_ratio_3_10": W.clip(col("_r3") / over("_r10"), -5, 5),
        "blk_cascade_ratio_5_20": W.clip(col("_r5") / over("_r20"), -5, 5),
        "blk_cascade_vol_expand": true((volumes[0] > volumes[1]) & (volumes[1] > volumes[2])),
        "blk_cascade_vol_compress": true((volumes[0] < volumes[1]) & (volumes[1] < volumes[2])),
        "blk_cascade_return_rank": F.when(col("_n") >= 5, F.when(today.isNull(), 0.5).otherwise(no_more / F.count("_size").over(W.trailing(5)))),
        "blk_return_roughness": W.clip(total("_size", 5, 2) / (F.abs("_r5") + 1e-10), 0, 20),
        "blk_3d_kurtosis": W.clip(unbiased_moments(col("ret"), W.trailing(15), 8)[1], -10, 50),
        "blk_5d_dispersion": std("_r5", 50, 10),
    }
    rows = rows.withColumns(found)
    for n, window, least in ((3, 60, 10), (5, 50, 15)):
        lane = Window.partitionBy("symbol", f"_lane{n}").orderBy("date")
        start = F.max(f"_restart{n}").over(lane.rowsBetween(Window.unboundedPreceding, 0))
        now, earlier = col(f"_r{n}"), col(f"_earlier{n}")
        both = F.count(F.when(earlier.isNotNull(), now)).over(W.trailing(window)) >= least
        levels, peaks, depths = (col(f"_{c}{n}") for c in ("levels", "peaks", "depths"))
        rows = rows.withColumn(f"_peaks{n}", _running_max(f"_levels{n}"))
        rows = rows.withColumn(f"_depths{n}", F.zip_with(levels, peaks, lambda x, peak: (x - peak) / (peak + 1e-10)))
        deepest = F.abs(F.array_min(depths))
        at = F.array_position(depths, F.array_min(depths)).cast("int") - 1
        back = (F.get(levels, F.lit(n - 1)) - F.get(levels, at)) / (F.get(peaks, at) - F.get(levels, at) + 1e-10)
        # A fall that ends the block has nothing of it won back, as the formula gives.
        won = F.when(deepest > 1e-6, W.clip(back, 0, 1)).otherwise(1.0)
        rows = rows.withColumns(
            {
                f"blk_boundary_{n}d_streak": (col("_n") - start) / n + 1,
                f"blk_{n}d_autocorr": F.when(both, W.correlation(now, earlier, W.trailing(window))),
                f"blk_{n}d_max_drawdown": F.when(levels.isNotNull(), deepest),
                f"blk_{n}d_recovery_ratio": F.when(levels.isNotNull(), won),
                f"blk_{n}d_vol_return_agree": mean("_with_volume", n, 1),
            }
        )
    return _done(rows.withColumn("blk_hurst_proxy", mean("_same", 20, 5)), BLOCKS)


SIGNED = [f"psig_{c}_{n}d" for n in (5, 10, 20) for c in ("sig1", "sig2", "sig2_anti", "logsig1", "path_length")] + ["psig_sig_ratio", "psig_momentum_asym"]


def _iterated(steps: str, of: str, earlier: str) -> Column:
    """The sum of each step's ``of`` times the sum of ``earlier`` over the steps before it."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("area"))
    add = lambda s, step: F.struct((s["sum"] + step[earlier]).alias("sum"), (s["area"] + step[of] * s["sum"]).alias("area"))
    return F.aggregate(steps, start, add, lambda s: s["area"])


def path_signatures(rows: DataFrame) -> DataFrame:
    """Iterated sums of the path of (return, volume against its 20-day mean) over 5, 10 and 20 days.

    ``sig2`` is the sum of a return times all earlier volume steps of the window, ``sig2_anti`` less the same with the two swapped
    (twice the area that the path sweeps). One fold over the window gives each, so a window without volume steps has exactly 0.
    A return that is missing counts as no move, a volume without a mean as the mean.
    """
    usual = mean("volume", 20)
    rows = rows.withColumns({"_x": F.coalesce("ret", F.lit(0.0)), "_v": F.when(usual > 0, col("volume") / usual).otherwise(1.0)})
    rows = rows.withColumns({"_y": col("_v") - F.coalesce(before("_v", 1), col("_v")), "_n": F.row_number().over(W.ordered())})
    for n in (5, 10, 20):
        w = W.trailing(n)
        net = F.sum("_x").over(w)
        rows = rows.withColumn("_steps", F.collect_list(F.struct(col("_x").alias("x"), col("_y").alias("y"))).over(w))
        later, swapped = _iterated("_steps", "x", "y"), _iterated("_steps", "y", "x")
        full = lambda x, n=n: F.when(col("_n") >= n, x)
        rows = rows.withColumns(
            {
                f"psig_sig1_{n}d": full(net),
                f"psig_sig2_{n}d": full(later),
                f"psig_sig2_anti_{n}d": full(later - swapped),
                f"psig_logsig1_{n}d": full(F.signum(net) * F.log1p(F.abs(net))),
                f"psig_path_length_{n}d": full(F.sum(F.abs("_x")).over(w)),
            }
        )
    ratio = col("psig_sig2_20d") / (F.abs("psig_sig2_5d") + 1e-10)
    return _done(rows.withColumns({"psig_sig_ratio": ratio, "psig_momentum_asym": zscore("psig_sig2_anti_20d", 60, 20)}), SIGNED)


TIMED = (
    "prev_return prev_range prev_body prev_upper_wick prev_lower_wick body_position volatility_5d volatility_20d volatility_ratio range_5d_avg range_vs_avg "
    "momentum_3d momentum_5d momentum_10d close_vs_ma5 close_vs_ma20 day_of_week is_monday is_friday volume_ratio volume_trend gap gap_filled_prev "
    "similar_day_entry similar_day_exit"
).split()
PREMARKET = ["pm_range", "pm_direction", "pm_volume_pct", "pm_vs_prev_close"]


def timing_features(rows: DataFrame, premarket: DataFrame | None = None) -> DataFrame:
    """What a day tells of the best time to enter and leave: its shape, volatility, momentum, calendar, volume and gap.

    ``similar_day_entry`` and ``similar_day_exit`` are minutes from the open that follow the usual five-day volatility.
    ``premarket`` (``symbol, date`` and ``PREMARKET``, from ``premarket_shape``) is joined where it is given; days without it are 0.
    """
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    of_open = lambda x: F.try_divide(x, col("open"))
    rows = rows.withColumns({"prev_return": change("close"), "prev_range": of_open(col("high") - col("low"))})
    rows = rows.withColumns(
        {
            "prev_body": of_open(F.abs(col("close") - col("open"))),
            "prev_upper_wick": of_open(col("high") - top),
            "prev_lower_wick": of_open(bottom - col("low")),
            "body_position": (col("close") - col("low")) / (col("high") - col("low") + 1e-8),
            "volatility_5d": std("prev_return", 5),
            "volatility_20d": std("prev_return", 20),
            "range_5d_avg": mean("prev_range", 5),
            **{f"momentum_{n}d": change("close", n) for n in (3, 5, 10)},
            **{f"close_vs_ma{n}": F.try_divide(col("close"), mean("close", n)) - 1 for n in (5, 20)},
            "day_of_week": F.weekday("date").cast("double"),
            "is_monday": true(F.weekday("date") == 0),
            "is_friday": true(F.weekday("date") == 4),
            "volume_ratio": F.try_divide(col("volume"), mean("volume", 20)),
            "volume_trend": change("volume", 5),
            "gap": F.try_divide(col("open"), before("close", 1)) - 1,
            "gap_filled_prev": true((before("low", 1) <= before("close", 2)) | (before("high", 1) >= before("close", 2))),
        }
    )
    usual = mean("volatility_5d", 20) * 60
    rows = rows.withColumns(
        {
            "volatility_ratio": col("volatility_5d") / (col("volatility_20d") + 1e-8),
            "range_vs_avg": col("prev_range") / (col("range_5d_avg") + 1e-8),
            "similar_day_entry": usual,
            "similar_day_exit": 300 + usual,
        }
    )
    if premarket is None:
        return _done(rows, TIMED)
    return _done(rows.join(premarket.select("symbol", "date", *PREMARKET), ["symbol", "date"], "left"), [*TIMED, *PREMARKET])


def premarket_shape(bars: DataFrame, opens: int = 570) -> DataFrame:
    """``symbol, date`` and range, direction, share of the day's volume and level against the day's first close of the bars before minute ``opens``.

    ``bars`` has ``symbol, date, minute, open, high, low, close, volume``, one row a minute. It is one aggregation by day; undefined values are null.
    """
    early = col("minute") < opens
    only = lambda x: F.when(early, col(x))
    days = bars.groupBy("symbol", "date").agg(
        F.max(only("high")).alias("high"),
        F.min(only("low")).alias("low"),
        F.max_by(only("close"), only("minute")).alias("close"),
        F.min_by(only("open"), only("minute")).alias("open"),
        F.sum(only("volume")).alias("early"),
        F.sum("volume").alias("volume"),
        F.min_by("close", "minute").alias("first"),
    )
    return days.select(
        "symbol",
        "date",
        F.try_divide(col("high") - col("low"), col("close")).alias("pm_range"),
        F.try_divide(col("close") - col("open"), col("open")).alias("pm_direction"),
        F.when(col("volume") > 0, col("early") / col("volume")).alias("pm_volume_pct"),
        F.when(col("first") > 0, col("close") / col("first") - 1).alias("pm_vs_prev_close"),
    )
