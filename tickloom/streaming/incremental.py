"""Realized variance and bipower variation that grow with a stream of ticks.

State of a (symbol, day): the last price and absolute return, and the sums. Rows of a micro-batch are
taken in time order; ticks that come out of order across batches count where they arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "symbol string, day string, n long, rrvar double, rbpvar double"
STATE = "price double, a double, n long, rv double, bp double"


def incremental(ticks: DataFrame) -> DataFrame:
    """A streaming DataFrame of ticks -> updates (symbol, day, n, rrvar, rbpvar), the latest one counts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, a, n, rv, bp = state.get if state.exists else (math.nan, math.nan, 0, 0.0, 0.0)
        for row in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
            if price == price:
                r = abs(math.log(row.price / price))
                n, rv = n + 1, rv + r * r
                bp += r * a if a == a else 0.0
                a = r
            price = row.price
        state.update((price, a, n, rv, bp))
        yield pd.DataFrame({"symbol": [key[0]], "day": [key[1]], "n": [n], "rrvar": [rv], "rbpvar": [math.pi / 2 * bp]})

    return ticks.groupBy("symbol", "day").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
