"""A staged plan: named expressions in layers over bars, run by Spark and, as CTEs, by any SQL engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.operators.recursive import ema_layers, ema_sql


@dataclass
class Plan:
    """``stages`` are layers of {column: expression}; ``ema`` are recursive columns computed after a given layer.

    A recursive column is (input column, weight, warm-up rows).
    """

    out: list[str]
    stages: list[dict[str, str]] = field(default_factory=list)
    ema: dict[int, dict[str, tuple[str, float, int]]] = field(default_factory=dict)
    digits: int = 6
    flags: bool = False

    def spark(self, bars: DataFrame) -> DataFrame:
        # windows over few bars cost time, not bytes: a partition count given here is not coalesced by size
        df = bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")
        layers: list[dict[str, str]] = []
        for k, stage in enumerate(self.stages):
            layers += [stage, *ema_layers(self.ema.get(k, {}))]
        for layer in layers:
            df = df.selectExpr("*", *[f"{x} AS `{c}`" for c, x in layer.items()])
        return df.selectExpr("symbol", "CAST(time AS STRING) AS time", *[self._last(c) for c in self.out])

    def _last(self, c: str) -> str:
        return f"`{c}`" if self.flags else f"round(`{c}`, {self.digits}) AS `{c}`"

    def sql(self, bars: str) -> str:
        ctes, at = [f"s0 AS ({bars})"], 0
        layers: list[dict[str, str]] = []
        for k, stage in enumerate(self.stages):
            layers.append(stage)
            if k in self.ema:
                layers += [{c: ema_sql(*spec)} for c, spec in self.ema[k].items()]  # each may read the one before
        for layer in layers:
            ctes.append(f"s{at + 1} AS (SELECT *, " + ", ".join(f'{_duck(x)} AS "{c}"' for c, x in layer.items()) + f" FROM s{at})")
            at += 1
        cols = ", ".join(f'"{c}"' if self.flags else f'round("{c}", {self.digits}) AS "{c}"' for c in self.out)
        return "WITH " + ",\n".join(ctes) + f"\nSELECT symbol, CAST(time AS VARCHAR) AS time, {cols} FROM s{at}"


def _duck(x: str) -> str:
    """Double literals as DuckDB writes them."""
    return re.sub(r"(?<![\w.])(-?\d+(?:\.\d+)?(?:E-?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", x).replace("percentile(", "quantile_cont(")


Query = Callable[..., DataFrame]
