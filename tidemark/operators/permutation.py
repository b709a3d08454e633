"""Two groups of events compared: Welch t over date averages, and a permutation test within strata.

A trial is not an array but rows: every event draws a number, an MD5 digest of
seed, trial and event, and in each (trial, stratum) the lowest draws are flagged,
as many as really are. Draws depend on nothing else, so a rerun or another
partitioning gives the same p. Per trial only the sum over the flagged goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Dates that a group needs.
DATES = 5


def _draw(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def compare(events: DataFrame, value: str, trials: int = 2000, seed: int = 7) -> DataFrame:
    """One row that compares flagged with other events: counts, dates, means in basis points, t values and the permutation's p.

    ``events`` is (symbol, date, flag, value), one row for each symbol and date;
    rows without a value (null or NaN) are left out. Events of one date are averaged first for
    means and t. Flags are shuffled within symbol and year; p is two-sided, with
    the real difference as one of the trials. Below DATES dates in a group there
    are only counts and a note.
    """
    ev = events.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("symbol", "date", "flag", F.col(value).cast("double").alias("v"))
    by_date = ev.groupBy("flag", "date").agg(F.avg("v").alias("v")).groupBy("flag").agg(F.count("v").alias("dates"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    of = lambda c, side: F.max(F.when(F.col("flag") == side, F.col(c)))
    means = by_date.agg(*[of(c, side).alias(f"{c}_{name}") for side, name in ((True, "flag"), (False, "noflag")) for c in ("dates", "mean", "var")])
    counts = ev.agg(F.count_if("flag").alias("n_flag"), F.count_if(~F.col("flag")).alias("n_noflag"), F.sum(F.when(F.col("flag"), F.col("v"))).alias("real"), F.sum("v").alias("total"))

    year = F.year("date")
    strata = ev.groupBy("symbol", year.alias("year")).agg(F.count_if("flag").alias("k"))
    rows = ev.withColumn("year", year).join(strata.where("k > 0"), ["symbol", "year"])  # a stratum without flags adds nothing
    rows = rows.select("symbol", "year", "date", "v", "k", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    place = F.row_number().over(W.partitionBy("trial", "symbol", "year").orderBy(_draw(seed, F.col("trial"), F.col("symbol"), F.col("date")), "date"))
    sums = rows.withColumn("place", place).where("place <= k").groupBy("trial").agg(F.sum("v").alias("s"))
    gap = lambda s: s / F.col("n_flag") - (F.col("total") - s) / F.col("n_noflag")
    # twelve digits: the same shuffle summed in another order must tie with the real one
    size = lambda s: F.round(F.abs(gap(s)), 12)
    null = sums.crossJoin(F.broadcast(counts)).agg(F.count_if(size(F.col("s")) >= size(F.col("real"))).alias("beyond"))  # counts is one row

    out = counts.crossJoin(means).crossJoin(null)
    enough = (F.coalesce("dates_flag", F.lit(0)) >= DATES) & (F.coalesce("dates_noflag", F.lit(0)) >= DATES)
    se = F.sqrt(F.col("var_flag") / F.col("dates_flag") + F.col("var_noflag") / F.col("dates_noflag"))
    ratio = lambda a, b: a / F.when(b > 0, b)
    full = {
        "mean_flag_bp": F.round(F.col("mean_flag") * 1e4, 1), "mean_noflag_bp": F.round(F.col("mean_noflag") * 1e4, 1), "diff_bp": F.round((F.col("mean_flag") - F.col("mean_noflag")) * 1e4, 1),
        "t": F.round(ratio(F.col("mean_flag") - F.col("mean_noflag"), se), 2), "t_flag": F.round(ratio(F.col("mean_flag"), F.sqrt(F.col("var_flag") / F.col("dates_flag"))), 2), "t_noflag": F.round(ratio(F.col("mean_noflag"), F.sqrt(F.col("var_noflag") / F.col("dates_noflag"))), 2),
        "perm_p": F.round((F.col("beyond") + 1) / (trials + 1), 4), "note": F.lit(None).cast("string"),
    }
    short = {"note": F.lit("too few events")}
    return out.select("n_flag", "n_noflag", "dates_flag", "dates_noflag", *[F.when(enough, v).otherwise(short.get(c)).alias(c) for c, v in full.items()])
