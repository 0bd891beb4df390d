"""Observation tables built from the test tables, and their prepared and scored forms.

``obs`` carries spectral bands (from line items), ``climate`` carries heat and
rain only (from events). A workspace settles the prepared and the scored table
once per session and source folder, as an analyst would after loading.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import literal_table
from fieldglass.operators.anomaly import with_anomaly
from fieldglass.operators.risk import with_risk
from fieldglass.operators.schema import prepare
from fieldglass.runtime import settle, small_enough


#: row groups of the prepared tables; the test tables are one group each, which one task would read alone
GROUP_BYTES = 4 << 20


@lru_cache
def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema and file list are read once per session."""
    return _stored(spark, f"{sf_dir}/{name}.parquet")


def row_key() -> F.Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.date_format("l_shipdate", "yyyyMMddHHmmss"))


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    # nation and region have a fixed 25 and 5 rows; suppliers go to every task as long as their size allows, so that the
    # line items, the large side, are neither shuffled nor sorted
    nations = F.broadcast(table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), c("n_regionkey") == c("r_regionkey")))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supplier = F.broadcast(supplier) if small_enough(supplier) else supplier
    rows = table(spark, sf_dir, "lineitem").join(supplier, c("l_suppkey") == c("s_suppkey"))
    rows = rows.join(nations, c("s_nationkey") == c("n_nationkey"))
    return rows.select(
        row_key().alias("row_id"), c("l_shipdate").alias("timestamp"),
        (8 + c("n_nationkey")).cast("double").alias("latitude"),
        (68 + c("n_nationkey")).cast("double").alias("longitude"),
        c("n_name").alias("region"), c("r_name").alias("state"),
        F.when(c("l_linenumber") != 7, c("l_discount")).alias("red"), c("l_tax").alias("green"),
        (c("l_linenumber").cast("double") / 100).alias("blue"),
        F.when(c("l_quantity") == 1, -c("l_discount")).otherwise(c("l_quantity") / 100).alias("nir"),
        (c("l_extendedprice") / 200000).alias("swir"),
        F.when(c("l_orderkey") % 11 != 0, (10 + c("l_partkey") % 30).cast("double")).alias("temperature"),
        F.when(c("l_orderkey") % 7 != 0, (c("l_suppkey") % 40).cast("double") / 4).alias("rainfall"),
    )


def climate_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cities = [(i, name) for i, (name, _, _) in enumerate(V.STATIONS)] + [(20, "Atlantis")]
    dim = literal_table(spark, ["slot", "region"], cities)
    rows = table(spark, sf_dir, "events").join(F.broadcast(dim), c("user_id") % 22 == c("slot"), "left")
    return rows.select(
        c("event_id").alias("row_id"), c("ts").alias("timestamp"), "region",
        F.when(c("event_id") % 13 != 0, (15 + c("event_id") % 25).cast("double")).alias("temperature"),
        F.when(c("event_id") % 9 != 0, c("value") / 10).alias("rainfall"),
    )


def climate_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climate rows in the shape of a station feed: year, day of year, -999 for missing."""
    raw = climate_raw(spark, sf_dir)
    return raw.select(
        F.year("timestamp").alias("YEAR"), F.dayofyear("timestamp").alias("DOY"),
        F.coalesce("temperature", F.lit(float(V.FEED_MISSING))).alias("T2M"),
        F.coalesce("rainfall", F.lit(float(V.FEED_MISSING))).alias("PRECTOTCORR"),
        "region",
    )


def score(prepared: DataFrame, method: str = "zscore") -> DataFrame:
    return with_risk(with_anomaly(prepared, method=method))


class Workspace:
    """Prepared and scored tables of one source folder, written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def unwritten(self) -> DataFrame:
        """The prepared rows, computed by every pass: for queries that read few of the columns once or twice."""
        return prepare(obs_raw(self.spark, self.sf_dir))

    @cached_property
    def obs(self) -> DataFrame:
        return settle(prepare(obs_raw(self.spark, self.sf_dir)), "obs", GROUP_BYTES)

    @cached_property
    def climate(self) -> DataFrame:
        return settle(prepare(climate_raw(self.spark, self.sf_dir)), "climate", GROUP_BYTES)

    @cached_property
    def scoring(self) -> DataFrame:
        """The scored rows, not written: ranks and moments are known, so one more pass gives them to a query that reads them once."""
        return score(self.obs)

    @cached_property
    def scored(self) -> DataFrame:
        return settle(self.scoring, "obs-scored", GROUP_BYTES)

    @cached_property
    def climate_scored(self) -> DataFrame:
        return settle(score(self.climate), "climate-scored", GROUP_BYTES)

    @cached_property
    def forest_anomaly(self) -> DataFrame:
        """The forest's scores alone; it has written them already, and risk has no part in them."""
        return with_anomaly(self.obs, method="forest")

    @cached_property
    def forest(self) -> DataFrame:
        return settle(with_risk(self.forest_anomaly), "obs-forest", GROUP_BYTES)


_workspaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, str(sf_dir))
    return _workspaces[key]
