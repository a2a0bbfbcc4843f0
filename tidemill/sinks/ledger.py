"""A ledger of entries that are only ever added, with balances that are carried on and not counted anew.

Under ``path``: ``log/<position>`` holds one delivery each, ``accounts/<position>``
the balances after all deliveries up to it, ``audits/<n>`` what was reconciled.
A folder counts once its write was finished, so one cut short is as if it had
not been begun. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"
ENTRIES = f"pos long, account long, kind string, ref long, amount {MONEY}"
ACCOUNTS = f"account long, cash {MONEY}, reserved {MONEY}"
AUDITS = f"account long, wallet {MONEY}, reserved {MONEY}, free {MONEY}, drift {MONEY}, alert boolean"
KINDS = ("deposit", "reserve", "release", "settle")
#: Shortfall from which a drift is reported, in units of the last digit of money.
EPSILON = "0.000001"
#: New deliveries are small if the older ones have over so many times their bytes.
SMALL = 8


def _zero(c: Column | None = None) -> Column:
    zero = F.lit(0).cast(MONEY)
    return zero if c is None else F.coalesce(c, zero)


def _worth(of: dict[str, Column]) -> tuple[Column, Column]:
    """(cash, reserved) of the entries that share an account and a reference: a stake is reserved until it is released or settled; settled, it is lost for what it pays."""
    open_ = of["release"].isNull() & of["settle"].isNull()
    cash = _zero(of["deposit"]) + F.when(of["settle"].isNotNull(), of["settle"] - _zero(of["reserve"])).otherwise(_zero())
    return cash, F.when(open_, _zero(of["reserve"])).otherwise(_zero())


class Ledger:
    """Deposits, reservations of stakes, their releases, and settlements with what they pay.

    Of entries of one account, kind and ref the earliest delivery counts, and
    within a delivery the least amount, so repeated and late deliveries change nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folders(self, part: str) -> tuple[list[int], int]:
        """Positions whose write was finished, ascending, and the next that is free."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        home = at(f"{self.path}/{part}")
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return [], 1
        there = sorted(int(s.getPath().getName()) for s in fs.listStatus(home))
        return [p for p in there if fs.exists(at(f"{self.path}/{part}/{p}/_SUCCESS"))], (there[-1] if there else 0) + 1

    def _read(self, part: str, positions: list[int], schema: str) -> DataFrame:
        if not positions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{part}/{p}" for p in positions))

    def add(self, entries: DataFrame) -> int:
        """Append a delivery (account, kind, ref, amount); nothing that is there is read. Gives its position."""
        pos = self._folders("log")[1]
        rows = entries.select(F.lit(pos).cast("long").alias("pos"), "account", "kind", "ref", F.col("amount").cast(MONEY).alias("amount"))
        rows.write.parquet(f"{self.path}/log/{pos}")
        return pos

    def entries(self) -> DataFrame:
        return self._read("log", self._folders("log")[0], ENTRIES)

    def _bytes(self, positions: list[int]) -> int:
        """Size of the files of these deliveries."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(fs.getContentSummary(at(f"{self.path}/log/{p}")).getLength() for p in positions)

    def _moved(self, upto: int) -> DataFrame:
        """By account, what the deliveries behind ``upto`` change, by the older entries that share a reference with them.

        Those are looked up, or, where the new deliveries are not small beside
        the older ones, found as all entries are grouped once.
        """
        positions = self._folders("log")[0]
        old, new = [p for p in positions if p <= upto], [p for p in positions if p > upto]
        rows = self._read("log", new, ENTRIES)
        if old and self._bytes(new) * SMALL < self._bytes(old):
            keys = rows.select(F.col("account").alias("_a"), F.col("ref").alias("_r")).distinct()
            shared = F.col("account").eqNullSafe(F.col("_a")) & F.col("ref").eqNullSafe(F.col("_r"))
            rows = self._read("log", old, ENTRIES).join(keys, shared, "left_semi").unionByName(rows)
        elif old and new:
            rows = self._read("log", positions, ENTRIES)
        first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("pos", "amount")))
        g = rows.repartition("account", "ref").groupBy("account", "ref").agg(*(first(k).alias(k) for k in KINDS), F.max("pos").alias("last")).filter(F.col("last") > upto)
        now = _worth({k: F.col(f"{k}.amount") for k in KINDS})
        # the earliest entry counts, so what counted then still does
        then = _worth({k: F.when(F.col(f"{k}.pos") <= upto, F.col(f"{k}.amount")) for k in KINDS}) if upto else (_zero(), _zero())
        return g.groupBy("account").agg(*(F.sum(a - b).cast(MONEY).alias(n) for a, b, n in zip(now, then, ("cash", "reserved"), strict=True)))

    def balances(self, whole: bool = False) -> DataFrame:
        """account, cash (deposits and payments less lost stakes), reserved and available: the latest snapshot and the deliveries behind it, or, if whole, all deliveries."""
        held = [] if whole else self._folders("accounts")[0][-1:]
        moved = self._moved(held[0] if held else 0)
        both = self._read("accounts", held, ACCOUNTS).unionByName(moved)
        g = both.groupBy("account").agg(F.sum("cash").cast(MONEY).alias("cash"), F.sum("reserved").cast(MONEY).alias("reserved"))
        return g.withColumn("available", (F.col("cash") - F.col("reserved")).cast(MONEY))

    def recompute(self) -> int:
        """Write the balances after all deliveries as the snapshot that later ones go on from. Gives its position, 0 without deliveries."""
        upto = max(self._folders("log")[0], default=0)
        if upto not in (0, *self._folders("accounts")[0]):
            self.balances().drop("available").write.mode("overwrite").parquet(f"{self.path}/accounts/{upto}")
        return upto

    def reserve(self, requests: DataFrame) -> DataFrame:
        """Reserve the requests (account, ref, amount) that an account can pay, and give them.

        Those of one account are added up in the order of their references, and
        one is granted while the sum, refused ones included, is at most what is
        available. What was reserved before isn't asked again; of repeated
        references the least amount counts; amounts that aren't positive are refused.
        """
        asked = requests.groupBy("account", "ref").agg(F.min(F.col("amount").cast(MONEY)).alias("amount")).filter("amount > 0")
        held = self.entries().filter("kind = 'reserve'").select("account", "ref")
        asked = asked.join(held, ["account", "ref"], "left_anti").join(self.balances().select("account", "available"), "account")
        total = F.sum("amount").over(Window.partitionBy("account").orderBy("ref").rowsBetween(Window.unboundedPreceding, 0))
        granted = asked.withColumn("_total", total).filter("_total <= available")
        pos = self.add(granted.select("account", F.lit("reserve").alias("kind"), "ref", "amount"))
        return self._read("log", [pos], ENTRIES).select("account", "ref", "amount")

    def reconcile(self, wallets: DataFrame) -> DataFrame:
        """Hold the reserved sums against what the wallets (account, wallet) hold, note it in the audits, and give it.

        drift is how much more is reserved than there is, with an alert if that is
        a shortfall. An unknown wallet (none, or NULL) has no drift: 0 would hide one. Of several wallets of an account the least counts.
        """
        known = wallets.groupBy("account").agg(F.min(F.col("wallet").cast(MONEY)).alias("wallet"))
        rows = self.balances().select("account", "reserved").join(known, "account", "full")
        rows = rows.select("account", "wallet", _zero(F.col("reserved")).alias("reserved"))
        drift = (F.col("reserved") - F.col("wallet")).cast(MONEY)
        rows = rows.select("*", (_zero(F.col("wallet")) - F.col("reserved")).cast(MONEY).alias("free"), drift.alias("drift"), F.coalesce(drift > F.lit(EPSILON).cast("decimal(20,6)"), F.lit(False)).alias("alert"))
        n = self._folders("audits")[1]
        rows.write.parquet(f"{self.path}/audits/{n}")
        return self._read("audits", [n], AUDITS)
