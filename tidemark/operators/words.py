"""Symbol words of return windows: segment means as letters, how a word ends, and how unusual its letters are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W

#: The quartiles of the standard normal distribution, which part the letters a, b, c and d.
BREAKPOINTS = (-0.6745, 0.0, 0.6745)
#: Endings of rising and falling words.
RISING = ("cd", "dd")
FALLING = ("aa", "ab")
#: Shares below this count as this.
LEAST = 1e-12


def symbol_words(bars: DataFrame, window: int = 20, segments: int = 5, history: int = 50) -> DataFrame:
    """Words over the last ``window`` logarithmic returns of ``symbol, date, close``.

    ``sax_word`` has a letter for each of ``segments`` equal parts, by the part's mean distance from the window's mean in population
    deviations; a window without spread is all ``c``, a part without returns ``d``. ``sax_pattern_20d`` reads the word as a number to base 4,
    ``sax_pattern_match`` is 1 or -1 for a rising or falling ending, and ``sax_novelty`` the divergence of the word's letters from their mean
    over ``history`` days. Days before a first full window have no word and 0; closes that aren't positive give no return.
    """
    days = W.ordered()
    n = F.row_number().over(days)
    price = F.when(F.col("close") > 0, F.ln("close"))
    moved = bars.withColumns({"_n": n, "_x": F.when(n == 1, 0.0).otherwise(price - F.lag(price).over(days))})
    size = window // segments
    whole = W.trailing(size * segments)
    moved = moved.withColumns({"_mean": F.mean("_x").over(whole), "_spread": F.stddev_pop("_x").over(whole)})
    parts = [days.rowsBetween(size * (s - segments) + 1, size * (s - segments + 1)) for s in range(segments)]
    moved = moved.withColumns({f"_s{s}": F.mean("_x").over(part) for s, part in enumerate(parts)})

    def letter(s: int) -> Column:
        z = (F.col(f"_s{s}") - F.col("_mean")) / F.col("_spread")
        place = reduce(lambda a, b: a + b, [(z >= b).cast("int") for b in BREAKPOINTS])
        return F.when(F.coalesce(F.col("_spread"), F.lit(0.0)) < 1e-10, 2).otherwise(F.coalesce(place, F.lit(len(BREAKPOINTS))))

    full = F.col("_n") >= size * segments
    coded = moved.withColumn("_letters", F.when(full, F.array(*[letter(s) for s in range(segments)])))
    word = F.array_join(F.transform("_letters", lambda p: F.element_at(F.array(*[F.lit(c) for c in "abcd"]), p + 1)), "")
    share = lambda p: F.coalesce(F.size(F.filter("_letters", lambda e: e == p)) / segments, F.lit(0.0))
    coded = coded.withColumns({"sax_word": word, **{f"_p{p}": F.when(full, share(p)).otherwise(0.0) for p in range(4)}})
    usual = W.trailing(history)
    coded = coded.withColumns({f"_q{p}": F.greatest(F.mean(f"_p{p}").over(usual), F.lit(LEAST)) for p in range(4)})
    coded = coded.withColumns({f"_p{p}": F.greatest(f"_p{p}", F.lit(LEAST)) for p in range(4)})
    total = lambda c: reduce(lambda a, b: a + b, [F.col(f"_{c}{p}") for p in range(4)])
    terms = [F.col(f"_p{p}") / total("p") * F.ln(F.col(f"_p{p}") / total("p") / (F.col(f"_q{p}") / total("q"))) for p in range(4)]
    novelty = F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))
    ending = F.substring("sax_word", -2, 2)
    number = F.aggregate("_letters", F.lit(0), lambda a, p: a * 4 + p).cast("double")
    return coded.select(
        "symbol",
        "date",
        "sax_word",
        F.coalesce(number, F.lit(0.0)).alias("sax_pattern_20d"),
        F.when(ending.isin(*RISING), 1.0).when(ending.isin(*FALLING), -1.0).otherwise(0.0).alias("sax_pattern_match"),
        F.when(F.col("_n") >= history, novelty).otherwise(0.0).alias("sax_novelty"),
    )
