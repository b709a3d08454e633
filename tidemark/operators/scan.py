"""Exponential averages as native prefix scans: windows and sums only, no pass in Python.

The average y = d y' + w x (d = 1 - w) composes as maps (a, b) of y -> a y + b.
Within a block of rows the composed map has a closed form, d^i and
d^i * sum(w x d^-j), a running sum; from block to block one carry is enough.
It starts at the first value. A null repeats the value before; after a gap of g
rows the new value weighs w against d^g, scaled so that the weights sum to 1,
which multiplies the map by a running product.

``averages`` takes a symbol's bars in one window, as the trailing windows around
it do. ``averages_by_chunk`` spreads one symbol over many tasks: each chunk of
time is composed on its own, the chunks' maps, a row each, are scanned over the
symbol, and the carries are joined back.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Powers of d within a block stay above exp(-DEEP); what lies a block of exp(-FADED) back has no weight in a double.
DEEP, FADED = 600.0, 80.0
#: Blocks are no longer than this.
LONGEST = 1 << 13


def _blocks(weights: set[float]) -> dict[float, int]:
    """A block length for each weight, as few different ones as the powers allow."""
    if not all(0 < w < 1 for w in weights):
        raise ValueError("weights lie between 0 and 1")
    out, length = {}, 0
    for w in sorted(weights, reverse=True):  # fastest first
        rate = -log(1 - w)
        if length * rate < FADED:
            length = max(1, min(floor(DEEP / rate), max(LONGEST, floor(FADED / rate) + 1)))
        out[w] = length
    return out


def _power(base: float, k: Column) -> Column:
    return F.pow(F.lit(base), k.cast("double"))


def _map(x: Column, w: float, gap: Column) -> tuple[Column, Column]:
    """The part of a value's map that is its own: what it adds before decay by place, and the log of the scale after a gap."""
    d = 1 - w
    scale = _power(d, gap) + w
    first = gap.isNull()
    added = F.when(x.isNull(), 0.0).when(first, x).otherwise(F.lit(w) * x)
    return added, F.when(x.isNotNull() & (gap > 1), -F.log(scale)).otherwise(0.0)


def layers(columns: dict[str, tuple[str, float, int]], by: str = "symbol", at: str = "time") -> list[dict[str, str]]:
    """One average for each entry, (input column, weight, values before it is shown), as layers of SQL expressions over the rows."""
    lengths = _blocks({w for _, w, _ in columns.values()})
    key = f"PARTITION BY {by} ORDER BY {at}"
    so_far, before = f"({key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inputs = {x: k for k, x in enumerate(sorted({x for x, _, _ in columns.values()}))}
    mark = "_".join(columns)[:40]  # keeps the helpers of several groups of averages apart
    n = f"_n_{mark}"
    first = {n: f"row_number() OVER ({key}) - 1"} | {f"_c{k}_{mark}": f"count({x}) OVER {so_far}" for x, k in inputs.items()}
    gaps = {f"_g{k}_{mark}": f"{n} - max(CASE WHEN {x} IS NOT NULL THEN {n} END) OVER {before}" for x, k in inputs.items()}
    gone, sums, carry, out = {}, {}, {}, {}
    for c, (x, w, warm) in columns.items():
        d, length, k = f"{1 - w!r}D", lengths[w], inputs[x]
        block, gap = f"(PARTITION BY {by}, floor({n} / {length}) ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"_g{k}_{mark}"
        # after a gap the weights d^gap and w are scaled to sum to 1; a value's own scale is not yet in the product that it is divided by
        scale = f"CASE WHEN {x} IS NOT NULL AND {gap} > 1 THEN -ln(power({d}, {gap}) + {w!r}D) ELSE 0D END"
        added = f"CASE WHEN {x} IS NULL THEN 0D WHEN {gap} IS NULL THEN CAST({x} AS DOUBLE) ELSE {w!r}D * {x} END"
        gone[f"_l_{c}"] = f"sum({scale}) OVER {block}"
        sums[f"_s_{c}"] = f"sum({added} / (power({d}, {n} % {length}) * exp(_l_{c} - ({scale})))) OVER {block}"
        local = f"_s_{c} * power({d}, {n} % {length}) * exp(_l_{c})"
        carry[f"_k_{c}"] = f"last_value(CASE WHEN {n} % {length} = {length - 1} THEN {local} END, true) OVER {before}"
        shown = f"last_value(CASE WHEN {x} IS NOT NULL THEN {local} + coalesce(_k_{c}, 0D) * power({d}, {n} % {length} + 1) * exp(_l_{c}) END, true) OVER {so_far}"
        out[c] = f"CASE WHEN _c{k}_{mark} >= {max(warm, 1)} THEN {shown} END"
    return [first, gaps, gone, sums, carry, out]


def averages(df: DataFrame, columns: dict[str, tuple[str, float, int]], by: str = "symbol", at: str = "time") -> DataFrame:
    """The rows with one average for each entry; no entry reads another."""
    kept = df.columns
    for layer in layers(columns, by, at):
        df = df.selectExpr("*", *[f"{x} AS `{c}`" for c, x in layer.items()])
    return df.select(*kept, *columns)


def averages_by_chunk(df: DataFrame, columns: dict[str, tuple[str, float, int]], chunk: Column, by: str = "symbol", at: str = "time") -> DataFrame:
    """As ``averages``, with each (symbol, chunk) a unit of its own; ``chunk`` grows with time and bounds a unit's rows.

    A row without a value has none here. The rows are read three times: for the
    chunks' sizes, for their maps, to apply them. A chunk's rows must be few
    enough for the powers: DEEP / -log(1 - weight).
    """
    inputs = sorted({x for x, _, _ in columns.values()})
    kept = df.columns
    rows = df.withColumn("_chunk", chunk)
    own = W.partitionBy(by, "_chunk").orderBy(at)
    so_far, before = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_n": F.row_number().over(own)} | {f"_c{k}": F.count(F.col(x)).over(so_far) for k, x in enumerate(inputs)})
    rows = rows.withColumns({f"_p{k}": F.max(F.when(F.col(x).isNotNull(), F.col("_n"))).over(before) for k, x in enumerate(inputs)})
    counts = [F.max("_n").alias("_rows")] + [F.max(f"_c{k}").alias(f"_m{k}") for k in range(len(inputs))] + [F.max(F.when(F.col(x).isNotNull(), F.col("_n"))).alias(f"_e{k}") for k, x in enumerate(inputs)]
    sizes = rows.groupBy(by, "_chunk").agg(*counts)
    chunks = W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_from": F.coalesce(F.sum("_rows").over(chunks), F.lit(0))} | {f"_h{k}": F.coalesce(F.sum(f"_m{k}").over(chunks), F.lit(0)) for k in range(len(inputs))})
    sizes = sizes.withColumns({f"_z{k}": F.last(F.col("_from") + F.col(f"_e{k}"), ignorenulls=True).over(chunks) for k in range(len(inputs))})
    sizes = sizes.drop("_rows", *[f"_m{k}" for k in range(len(inputs))], *[f"_e{k}" for k in range(len(inputs))])
    rows = rows.join(sizes, [by, "_chunk"])
    rows = rows.withColumns({f"_g{k}": F.col("_from") + F.col("_n") - F.coalesce(F.col("_from") + F.col(f"_p{k}"), F.col(f"_z{k}")) for k in range(len(inputs))})
    gone, sums = {}, {}
    for c, (x, w, _) in columns.items():
        added, scale = _map(F.col(x).cast("double"), w, F.col(f"_g{inputs.index(x)}"))
        gone[f"_l{c}"] = F.sum(scale).over(so_far)
        sums[f"_s{c}"] = F.sum(added / (_power(1 - w, F.col("_n")) * F.exp(F.col(f"_l{c}") - scale))).over(so_far)
    rows = rows.withColumns(gone).withColumns(sums)
    rows = rows.withColumns({f"_a{c}": _power(1 - w, F.col("_n")) * F.exp(f"_l{c}") for c, (_, w, _) in columns.items()})
    rows = rows.withColumns({f"_y{c}": F.col(f"_s{c}") * F.col(f"_a{c}") for c in columns})
    ends = rows.groupBy(by, "_chunk").agg(F.max_by(F.struct(*[F.struct(F.col(f"_a{c}").alias("a"), F.col(f"_y{c}").alias("b")).alias(c) for c in columns]), "_n").alias("m"))
    # the maps of all chunks before, composed in order: a fold over one short row for each chunk
    fold = {f"_k{c}": F.aggregate(F.collect_list(F.col("m")[c]).over(chunks), F.lit(0.0), lambda y, m: m["a"] * y + m["b"]) for c in columns}
    rows = rows.join(ends.select(by, "_chunk", *[v.alias(k) for k, v in fold.items()]), [by, "_chunk"])
    out = {}
    for c, (x, _, warm) in columns.items():
        k = inputs.index(x)
        out[c] = F.when(F.col(x).isNotNull() & (F.col(f"_h{k}") + F.col(f"_c{k}") >= max(warm, 1)), F.col(f"_y{c}") + F.col(f"_a{c}") * F.col(f"_k{c}"))
    return rows.withColumns(out).select(*kept, *columns)
