"""The bar cache: upsert, coverage, statistics, runs. Plain Parquet, partitioned; one writer at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.functions.intervals import DAY
from barsmith.operators import ranges
from barsmith.operators.tables import kept

KEY = ["symbol", "interval", "time"]
CANDLES = "time bigint, open double, high double, low double, close double, volume double, provider string, fetched_at bigint, symbol string, interval string, part bigint"
COVERAGE = "start bigint, end bigint, symbol string, interval string"
RUNS = "created_at bigint, primary_symbol string, interval string, status string, configuration string, summary string, run string"
#: Milliseconds of bars in one folder of the cache.
PART = 30 * DAY


def latest(existing: DataFrame, incoming: DataFrame, keys=KEY) -> DataFrame:
    """The rows of both, the last written one of each key (incoming wins a tie)."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("fetched_at"), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, incoming ones in the place of existing ones of the same key. Keys are unique in each."""
    return existing.join(incoming, keys, "left_anti").unionByName(incoming)


def statistics(candles: DataFrame) -> DataFrame:
    """Per symbol and interval, and in all (both null): bars, first and last time, provider (the last in the alphabet), last fetch."""
    out = candles.rollup("symbol", "interval").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("bars"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max("provider").alias("provider"), F.max("fetched_at").alias("last_fetch"))
    return out.where("_g in (0, 3)").drop("_g")


def latest_provider(candles: DataFrame) -> DataFrame:
    """Per symbol and interval the provider of the row fetched last."""
    return candles.groupBy("symbol", "interval").agg(F.max_by("provider", F.struct("fetched_at", "time")).alias("provider"))


def listed(runs: DataFrame, n: int = 50) -> DataFrame:
    """The newest runs with the figures that a list shows, read from the JSON of their summaries."""
    figure = lambda k, t: F.get_json_object("summary", f"$.{k}").cast(t).alias(k)
    return runs.orderBy(F.desc("created_at"), "run").limit(n).select("run", "created_at", "primary_symbol", "interval", "status", figure("trades_executed", "bigint"), figure("win_rate", "double"), figure("net_return", "double"))


#: What belongs to a run besides its header.
CHILDREN = ("matches", "trades")


def escaped(value: str) -> str:
    """A partition's value as Spark writes it in the name of a folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or ord(c) < 32 else c for c in value)


class Store:
    """Parquet tables under one folder. A write replaces the folders of the partitions that it touches, and no others.

    Rows are dealt out by folder before they are written, so a write makes one file in each, in order of time. What is
    forgotten is taken away folder by folder; nothing else is written again. Parquet folders know no transactions: one
    process writes at a time, and a reader of a partition that is being replaced may have to read again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _write(self, name: str, rows: DataFrame, by: list[str]) -> None:
        order = [c for c in ("time", "start") if c in rows.columns]
        rows.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _forget(self, path: str) -> bool:
        """Takes a folder away, whatever file system it is in; whether there was one."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def candles(self) -> DataFrame:
        return self._read("candles", CANDLES)

    def save_candles(self, candles: DataFrame) -> None:
        new = candles.withColumn("part", F.floor(F.col("time") / PART))
        touched = kept(new.select("symbol", "interval", "part").distinct(), "touched")
        old = self.candles().join(touched, ["symbol", "interval", "part"], "left_semi")
        self._write("candles", kept(latest(old, new), "upsert"), ["symbol", "interval", "part"])

    def load_candles(self, symbol: str, interval: str, start: int, end: int) -> DataFrame:
        """Opens the files of one series and stretch of time only."""
        inside = F.col("part").between(start // PART, end // PART) & F.col("time").between(start, end)
        return self.candles().where((F.col("symbol") == symbol) & (F.col("interval") == interval) & inside).select("symbol", "time", "open", "high", "low", "close", "volume")

    def coverage(self) -> DataFrame:
        return self._read("coverage", COVERAGE)

    def record_coverage(self, covered: DataFrame) -> None:
        new = covered.select("symbol", "interval", "start", "end")
        old = self.coverage().join(kept(new.select("symbol", "interval").distinct(), "touched"), ["symbol", "interval"], "left_semi")
        self._write("coverage", kept(ranges.merge(old.unionByName(new)), "coverage"), ["symbol", "interval"])

    def missing(self, requested: DataFrame) -> DataFrame:
        return ranges.missing(self.coverage(), requested)

    def clear(self, symbol: str | None = None) -> None:
        """Forgets all bars and coverage, or those of one symbol; coverage first, so bars without it are at worst fetched again."""
        for name in ("coverage", "candles"):
            self._forget(name if symbol is None else f"{name}/symbol={escaped(symbol)}")

    def save_run(self, header: DataFrame, matches: DataFrame, trades: DataFrame) -> None:
        """Tables with a column ``run``. Children first, the header last: a run without a header does not exist."""
        for name, rows in ((*zip(CHILDREN, (matches, trades)), ("runs", header))):
            self._write(name, rows, ["run"])

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def _children(self, name: str) -> DataFrame:
        """The rows of a table that has the columns of what was first saved; without any, none with a column ``run``."""
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}").withColumn("run", F.col("run").cast("string"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return self.spark.createDataFrame([], "run string")
            raise

    def load_run(self, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Header, matches and trades of a run; all empty for one that does not exist."""
        mine = F.col("run") == run
        header = self.runs().where(mine)
        return header, *(self._children(name).where(mine).join(header.select("run"), "run", "left_semi") for name in CHILDREN)

    def list_runs(self, n: int = 50) -> DataFrame:
        return listed(self.runs(), n)

    def counted_runs(self) -> DataFrame:
        """(run, created_at, matches, trades): each run with the number of its matches and trades."""
        out = self.runs().select("run", "created_at")
        for name in CHILDREN:
            out = out.join(self._children(name).groupBy("run").agg(F.count(F.lit(1)).alias(name)), "run", "left").fillna(0, [name])
        return out

    def _forget_runs(self, name: str, ids: DataFrame) -> None:
        for row in ids.select("run").toLocalIterator():
            self._forget(f"{name}/run={escaped(row['run'])}")

    def delete_runs(self, before: int, dry_run: bool = True) -> DataFrame:
        """Runs created before a time with the number of their matches and trades; they are forgotten unless ``dry_run``.

        A run's header goes first, so a run half taken away does not exist; what such runs have left goes with the
        next deletion. Only ids reach the driver, one at a time.
        """
        old = kept(self.counted_runs().where(F.col("created_at") < before), "old-runs")
        if not dry_run:
            self._forget_runs("runs", old)
            for name in CHILDREN:  # the headers are read anew, without those that have just gone
                self._forget_runs(name, self._children(name).select("run").distinct().join(self.runs(), "run", "left_anti"))
        return old


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
