"""A user's function as a node with declared ports: a table function whose schema follows from the ports.

The function takes (inputs, params, rng) for one bar and returns a dict of its
outputs. A ``scalar`` port gives the bar's value, a ``series`` port the values
of the last ``lookback`` bars, the bar's own behind; a port without a value is
left out. Draws depend on the seed, the symbol and the bar alone and outputs
are rounded to nine digits, so a whole series in a batch and each bar as a
step of its own agree.
"""

from __future__ import annotations

import json
import math
import random
from collections import deque
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidemill.sources import market as mk

DIGITS = Decimal("1e-9")
#: What a port may carry (fixed names).
TAGS = {"scalar": DoubleType(), "series": ArrayType(DoubleType()), "label": StringType()}
#: Bars that a series port goes back, unless stated.
LOOKBACK = 64


def _number(x) -> float | None:
    """Rounded half away from zero; what isn't finite is NULL."""
    if x is None or not math.isfinite(x := float(x)):
        return None
    return float(Decimal(repr(x)).quantize(DIGITS, ROUND_HALF_UP)) + 0.0 if abs(x) < 1e15 else x


def _out(value, tag: str):
    if value is None:
        return None
    if tag == "label":
        return str(value)
    return [_number(x) for x in value] if tag == "series" else _number(value)


class Ports:
    """The declared ports: JSON of inputs and outputs, each a name and a tag."""

    def __init__(self, text: str):
        found = json.loads(text)
        self.inputs, self.outputs = dict(found.get("inputs", {})), dict(found.get("outputs", {}))
        for name, tag in [*self.inputs.items(), *self.outputs.items()]:
            if tag not in TAGS:
                raise ValueError(f"port {name} has no known tag: {tag}")
        if not self.outputs:
            raise ValueError("a node needs an output")

    def schema(self) -> StructType:
        out = StructType().add("symbol", StringType()).add("open_time", LongType())
        for name, tag in self.outputs.items():
            out = out.add(name, TAGS[tag])
        return out


def call(function: Callable, ports: Ports, inputs: dict, params: dict, seed: int, symbol, open_time) -> tuple:
    """The outputs of one bar in the order of the ports; those the function doesn't give are NULL."""
    given = {k: v for k, v in inputs.items() if v is not None}
    out = function(given, params, random.Random(f"{seed}|{symbol}|{open_time}")) or {}
    return tuple(_out(out.get(name), tag) for name, tag in ports.outputs.items())


def _plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def node(function: Callable, lookback: int = LOOKBACK):
    """The table function (rows, ports, params, seed): a batch over each symbol's bars in time order, which remembers ``lookback`` of them."""

    @F.udtf
    class Node:
        @staticmethod
        def analyze(rows: AnalyzeArgument, ports: AnalyzeArgument, params: AnalyzeArgument, seed: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be a table")
            declared = Ports(ports.value)
            missing = {"symbol", "open_time", *declared.inputs} - set(rows.dataType.fieldNames())
            if missing:
                raise ValueError(f"no column for {sorted(missing)}")
            return AnalyzeResult(declared.schema(), partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("open_time")])

        def __init__(self):
            self.ports = None

        def eval(self, row, ports, params, seed):
            if self.ports is None:
                self.ports, self.params = Ports(ports), json.loads(params or "{}")
                self.past = {n: deque(maxlen=lookback) for n, tag in self.ports.inputs.items() if tag == "series"}
            inputs = {}
            for name, tag in self.ports.inputs.items():
                value = _plain(row[name])
                if tag == "series":
                    self.past[name].append(value)
                    value = list(self.past[name])
                inputs[name] = value
            yield (row["symbol"], row["open_time"], *call(function, self.ports, inputs, self.params, seed, row["symbol"], row["open_time"]))

    return Node


def register(spark: SparkSession, name: str, function: Callable, lookback: int = LOOKBACK) -> None:
    """Make the node a table function of SQL: ``SELECT * FROM name(TABLE(bars), '<ports>', '<params>', seed)``."""
    spark.udtf.register(name, node(function, lookback))


def batch(df: DataFrame, function: Callable, ports: dict, params: dict | None = None, seed: int = 0, lookback: int = LOOKBACK) -> DataFrame:
    """symbol, open_time and the outputs for every row of ``df``, each symbol in one pass in time order; open times of a symbol must differ."""
    text, given = json.dumps(ports), json.dumps(params or {})
    rows = df.select("symbol", "open_time", *Ports(text).inputs)
    return node(function, lookback)(rows.asTable(), F.lit(text), F.lit(given), F.lit(seed))


def step(df: DataFrame, function: Callable, ports: dict, params: dict | None = None, seed: int = 0) -> DataFrame:
    """The same for rows that stand alone, as they come in live: series ports are arrays already (see ``history``)."""
    declared = Ports(json.dumps(ports))
    kind = StructType(declared.schema().fields[2:])

    @F.pandas_udf(kind)
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in frame.to_dict("records"):
            inputs = {n: [_plain(x) for x in row[n]] if tag == "series" and row[n] is not None else _plain(row[n]) for n, tag in declared.inputs.items()}
            found.append(call(function, declared, inputs, params or {}, seed, row["symbol"], row["open_time"]))
        return pd.DataFrame(found, columns=list(declared.outputs), dtype=object)

    return df.select("symbol", "open_time", run(F.struct("symbol", "open_time", *declared.inputs)).alias("_o")).select("symbol", "open_time", "_o.*")


def history(df: DataFrame, ports: dict, lookback: int = LOOKBACK) -> DataFrame:
    """Rows with the arrays that series ports take, the row's own value last; a missing value is kept as NULL."""
    w = mk.series().rowsBetween(1 - lookback, 0)
    past = lambda n: F.transform(F.collect_list(F.struct(n)).over(w), lambda x: x[n]).alias(n)
    return df.select("symbol", "open_time", *(past(n) if tag == "series" else F.col(n) for n, tag in ports.get("inputs", {}).items()))
