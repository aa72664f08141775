"""Every registered query: a function of the session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.scalars import bare_name, month_end, month_start, partition_key
from mendwell.operators import context, diagnosis, drift, faults, gold, incidents, medallion, metrics, partitions
from mendwell.operators import quality, remediation, retries, similarity, snapshots
from mendwell.plans import surrogates as tables
from mendwell.session import work_dir
from mendwell.sources import files, footers, keyed_store, landing, weather_json
from mendwell.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = datetime(2001, 1, 1)
TODAY = date(2001, 9, 15)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Round doubles, whose last digits depend on the order of summation."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several operators read: computed once and written to the work folder."""
    return files.write_table(df, work_dir(df.sparkSession, name))


def joined(name: str, separator: str = ",") -> Column:
    return F.array_join(name, separator).alias(name)


# --- staging, join, aggregate ------------------------------------------------------


@query
def stage_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.stage_trips(tables.bronze_trips(spark, sf_dir))


@query
def stage_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(medallion.stage_weather(tables.bronze_weather(spark, sf_dir)))


@query
def dim_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.dim_zones(tables.zone_seed(spark, sf_dir))


@query
def trips_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = medallion.stage_weather(tables.bronze_weather(spark, sf_dir))
    return rounded(medallion.trips_weather(stage_trips(spark, sf_dir), weather))


@query
def trips_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = medallion.stage_weather(tables.bronze_weather(spark, sf_dir))
    return rounded(medallion.trips_daily_from_staging(stage_trips(spark, sf_dir), weather))


def _layout(spark: SparkSession, sf_dir: str) -> tuple[gold.Layout, DataFrame, DataFrame]:
    """Empty folders for partitioned trips, weather and gold, and what belongs there."""
    trips = tables.bronze_trips(spark, sf_dir)
    weather = tables.bronze_weather(spark, sf_dir).withColumns({"year": F.year("date"), "month": F.month("date")})
    roots = [work_dir(spark, name) for name in ("hive-trips", "hive-weather", "hive-gold")]
    return gold.Layout(*roots, trips.schema, weather.schema), trips, weather


def _gold(spark: SparkSession, layout: gold.Layout) -> DataFrame:
    return rounded(spark.read.parquet(layout.gold).drop("year", "month"))


@query
def gold_from_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table from trips and weather in a hive layout."""
    layout, trips, weather = _layout(spark, sf_dir)
    files.write_partitions(trips, layout.trips, ["year", "month"])
    files.write_partitions(weather, layout.weather, ["year", "month"])
    gold.build_gold(spark, layout)
    return _gold(spark, layout)


@query
def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table built without its last year and with half of one month, then brought up to date."""
    layout, trips, weather = _layout(spark, sf_dir)
    trips, weather = stored(trips, "trips"), stored(weather, "weather")
    last, some = trips.agg(F.max("year"), F.min(F.struct("year", "month"))).first()
    late = (F.col("year") == some["year"]) & (F.col("month") == some["month"])
    soon = (F.col("year") < last) & ~(late & (F.col("VendorID") % 2 == 0))
    files.write_partitions(trips.filter(soon), layout.trips, ["year", "month"])
    files.write_partitions(weather, layout.weather, ["year", "month"])
    gold.build_gold(spark, layout)
    files.write_partitions(trips.filter((F.col("year") == last) | late), layout.trips, ["year", "month"], replace=True)
    gold.build_gold(spark, layout)
    return _gold(spark, layout)


@query
def interim_trips_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = tables.bronze_weather(spark, sf_dir)
    return rounded(medallion.interim_trips_weather(tables.vintages(spark, sf_dir), weather))


# --- partitions, landing, schema ------------------------------------------------------


@query
def partition_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected partitions of every supplier from its first to the last shipment."""
    lines = tables.table(spark, sf_dir, "lineitem")
    bounds = lines.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("now"))
    return partitions.partition_calendar(bounds).select("l_suppkey", "partition_key", long("year"), long("month"))


@query
def missing_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without shipment in every part's calendar."""
    lines = tables.table(spark, sf_dir, "lineitem")
    landed = lines.select("l_partkey", month_start(F.col("l_shipdate")).alias("partition_date"))
    bounds = lines.groupBy("l_partkey").agg(F.min("l_shipdate").alias("start")).withColumn("now", F.lit(TODAY))
    missing = partitions.missing_partitions(
        partitions.partition_calendar(bounds), landed, ["l_partkey", "partition_date"]
    )
    return missing.select("l_partkey", "partition_key")


@query
def next_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next month to fetch for every part, unless it is not expected yet."""
    landed = tables.table(spark, sf_dir, "lineitem").select(
        "l_partkey", month_start(F.col("l_shipdate")).alias("partition_date")
    )
    due = partitions.next_partition(landed, TODAY, ["l_partkey"])
    return due.select("l_partkey", partition_key(F.col("candidate")).alias("candidate"))


@query
def published_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next months of every supplier that are published: those three months after a month of orders."""
    landed = tables.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", month_start(F.col("l_shipdate")).alias("partition_date")
    )
    due = partitions.next_partition(landed, date(2002, 1, 15), ["l_suppkey"])
    published = tables.table(spark, sf_dir, "orders").select(
        month_start(F.add_months(F.to_date("o_orderdate"), 3)).alias("candidate")
    )
    ready = partitions.unpublished_filter(due, published, ["candidate"])
    return ready.select("l_suppkey", partition_key(F.col("candidate")).alias("candidate"))


@query
def partition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = tables.trips_by_pickup_month(spark, sf_dir)
    profile = partitions.partition_profile(trips, ["year", "month"], medallion.PICKUP_ALIASES)
    return profile.select(long("year"), long("month"), "rows", "pickup_min", "pickup_max")


@query
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last calendar day of every order month with its folder."""
    months = tables.table(spark, sf_dir, "orders").select(month_start(F.col("o_orderdate")).alias("first_day")).distinct()
    folder = tables.hive_path("bronze/tlc/yellow", F.col("first_day"))
    return months.select("first_day", month_end(F.col("first_day")).alias("last_day"), folder.alias("folder"))


@query
def land_new_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the years up to 1997, then everything; the second call skips the first ones."""
    root = work_dir(spark, "landing")
    trips = tables.trips_by_pickup_month(spark, sf_dir)
    landing.land(trips.filter(F.col("year") <= 1997), root)
    status = landing.land(trips, root)
    landed = spark.read.parquet(root).groupBy("year", "month").agg(F.count("*").alias("stored_rows"))
    return status.join(landed, ["year", "month"], "full").select(
        long("year"), long("month"), "status", "rows", "stored_rows"
    )


@query
def scan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips landed by month, scanned back for two months behind the schema gate."""
    root = work_dir(spark, "scan")
    trips = tables.trips_by_pickup_month(spark, sf_dir)
    files.write_partitions(trips, root, landing.KEYS)
    scan = files.scan_partitions(spark, root, trips.schema, partitions=[(1996, 2), (1997, 11)])
    return scan.select("tpep_pickup_datetime", "VendorID", "PULocationID", long("year"), long("month"))


@query
def seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone seed as a CSV file with a header, read with a fixed schema."""
    path = work_dir(spark, "seed")
    tables.zone_seed(spark, sf_dir).write.option("header", True).csv(path)
    return files.publish_view(medallion.dim_zones(files.read_seed(spark, path)), "dim_zones")


@query
def latest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = tables.trips_by_pickup_month(spark, sf_dir).select("year", "month").distinct()
    return landing.latest_partition(landed).select(long("year"), long("month"))


def _drifting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land trips by year with the column rename applied to 1998 and to some files of 1996, and read the footers back."""
    root = work_dir(spark, "drift")
    trips = tables.trips_by_pickup_month(spark, sf_dir).drop("month")
    renamed = (F.col("year") == 1998) | ((F.col("year") == 1996) & (F.col("PULocationID") % 2 == 1))
    good, bad = trips.filter(~renamed), trips.filter(renamed)
    files.write_partitions(good, root, ["year"])
    files.write_partitions(faults.rename_trip_column(bad), root, ["year"])
    return footers.file_schemas(spark, root).withColumns(
        {"dataset": F.lit("trips"), "year": footers.path_part(F.col("path"), "year")}
    )


@query
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and fingerprint of every table, a file or a folder of files; a table whose files disagree has a row for each schema."""
    printed = drift.schema_fingerprint(footers.file_schemas(spark, sf_dir))
    return printed.select(
        F.regexp_extract("path", r"/([^/]+\.parquet)(/|$)", 1).alias("file_name"), "n_columns", "schema_fingerprint"
    ).distinct()


@query
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.schema_drift(_drifting_files(spark, sf_dir), "dataset", "year")
    names = lambda c: F.transform(c, lambda x: F.split(x, ":")[0]).alias(c)
    return found.select(long("year"), "changed", long("n_schemas"), names("added"), names("removed")).select(
        "year", "changed", "n_schemas", joined("added"), joined("removed")
    )


@query
def dq_expected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = drift.missing_columns(
        _drifting_files(spark, sf_dir).select("path", "columns"), ["VendorID", "tpep_pickup_datetime"]
    )
    year = footers.path_part(F.col("path"), "year").cast("bigint").alias("year")
    return gaps.select(year, "missing_column").distinct()


@query
def json_columns_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = weather_json.parse_payloads(tables.weather_payloads(spark, sf_dir))
    return rounded(weather_json.payload_rows(parsed))


@query
def json_payload_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = weather_json.parse_payloads(tables.weather_payloads(spark, sf_dir))
    bounds = weather_json.payload_bounds(parsed, ["year", "month"])
    return bounds.select(long("year"), long("month"), "days", "date_min", "date_max")


@query
def json_payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = weather_json.parse_payloads(tables.weather_payloads(spark, sf_dir))
    return weather_json.rejected_payloads(parsed).select(long("year"), long("month"), "reject_reason")


# --- data quality -------------------------------------------------------------------


def _typed_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze trips of both vintages before any guard drops rows."""
    united = medallion.resolve_alias(tables.vintages(spark, sf_dir), medallion.PICKUP_ALIASES, "pickup_ts")
    return united.withColumn("pickup_ts", F.col("pickup_ts").try_cast("timestamp_ntz"))


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null_counts(_typed_vintages(spark, sf_dir), ["pickup_ts", "fare_amount", "surcharge"])


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(tables.table(spark, sf_dir, "orders"), ["o_custkey"])


@query
def dq_unique_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(tables.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]
    customers = tables.table(spark, sf_dir, "customer")
    return customers.filter(quality.not_accepted("c_mktsegment", segments)).select("c_custkey", "c_mktsegment")


@query
def dq_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose order is not among the finished ones."""
    finished = tables.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.orphans(lines, "l_orderkey", finished, "o_orderkey")


@query
def dq_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    outside = quality.not_between("o_totalprice", 0, 400000, F.col("o_orderstatus") != "P")
    return orders.filter(outside).select("o_orderkey", "o_totalprice")


@query
def dq_no_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem")
    late = lines.filter(quality.in_future("l_shipdate", NOW, 24))
    return late.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")


@query
def dq_row_count_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select(
        "o_orderpriority", partition_key(F.col("o_orderdate")).alias("partition_key")
    )
    return rounded(quality.partition_counts_outside(orders, ["o_orderpriority"], "partition_key", 3, 10))


@query
def dq_row_count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table against a fixed expectation it cannot meet."""
    return quality.row_count_outside(tables.table(spark, sf_dir, "customer"), 1000.0, 10)


@query
def dq_row_count_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of an asset's calendar month without any event."""
    events = tables.table(spark, sf_dir, "events").select(
        F.col("user_id"), F.to_date("ts").alias("day")
    )
    spans = events.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    expected = spans.select("user_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return quality.empty_partitions(expected, events, ["user_id", "day"])


def _partitions_outside(given: dict[str, DataFrame]) -> DataFrame:
    """Months of bronze trips with a tenth more or fewer rows than the mean of the three months before."""
    month = F.format_string("%04d-%02d", "year", "month").alias("partition_key")
    counts = given["bronze"].groupBy("year", "month").agg(F.count("*").alias("n")).select(F.lit("trips").alias("dataset"), month, "n")
    before = Window.partitionBy("dataset").orderBy("partition_key").rowsBetween(-3, -1)
    expected = counts.withColumn("expected", F.avg("n").over(before))
    return expected.filter((F.col("n") < F.col("expected") * 0.9) | (F.col("n") > F.col("expected") * 1.1))


def _suite() -> list[quality.Check]:
    row, table = quality.RowCheck, quality.TableCheck
    avg_fare = F.col("avg_fare").isNotNull()
    return [
        # Staging leaves out trips without a pickup time, so nulls are looked for before it.
        row("pickup_ts_not_null", "bronze", quality.is_missing("tpep_pickup_datetime"), "warn"),
        row("dropoff_ts_not_null", "bronze", quality.is_missing("tpep_dropoff_datetime")),
        row("pickup_zone_not_null", "bronze", quality.is_missing("PULocationID")),
        row("silver_pickup_ts_not_null", "silver", quality.is_missing("pickup_ts")),
        row("silver_pickup_zone_not_null", "silver", quality.is_missing("pickup_zone_id")),
        row("weather_date_not_null", "weather", quality.is_missing("weather_date")),
        row("daily_date_not_null", "daily", quality.is_missing("pickup_date")),
        row("daily_zone_not_null", "daily", quality.is_missing("pickup_zone_id")),
        row("daily_trip_count_not_null", "daily", quality.is_missing("trip_count")),
        table("partition_row_count", "bronze", _partitions_outside, "warn"),
        quality.NonEmptyCheck("rowcount_positive", "trips"),
        table(
            "pickup_zone_known",
            "trips",
            lambda t: quality.orphans(t["trips"], "pickup_zone_id", t["zones"].filter("zone_id % 10 > 0"), "zone_id"),
            "warn",
        ),
        row("trip_count_positive", "daily", quality.not_between("trip_count", 0)),
        row("avg_fare_range", "daily", quality.not_between("avg_fare", 0, 500, avg_fare), "warn"),
        row("pickup_date_not_future", "daily", quality.in_future("pickup_date", NOW)),
        table("daily_grain", "daily", lambda t: quality.duplicates(t["daily"], medallion.GRAIN)),
        row("zone_id_not_null", "zones", quality.is_missing("zone_id")),
        table("zone_id_unique", "zones", lambda t: quality.duplicates(t["zones"], ["zone_id"])),
        row("borough_accepted", "zones", quality.not_accepted("borough", ["AFRICA", "AMERICA", "ASIA", "EUROPE"])),
        table("weather_date_unique", "weather", lambda t: quality.duplicates(t["weather"], ["weather_date"])),
    ]


@query
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole suite; tables that several checks read are written once.

    Planted faults: bronze trips of every 19th zone have no pickup time, and the dimension lacks every tenth zone.
    """
    # Trips meet the months of their orders once.
    bronze = stored(tables.bronze_trips(spark, sf_dir), "bronze")
    trips = stored(medallion.stage_trips(bronze), "staged")
    pickup = F.when(F.col("PULocationID") % 19 != 0, F.col("tpep_pickup_datetime"))
    bronze = bronze.withColumn("tpep_pickup_datetime", pickup)
    weather = medallion.stage_weather(tables.bronze_weather(spark, sf_dir))
    given = {
        "bronze": bronze,
        "trips": trips,
        "silver": medallion.trips_weather(trips, weather),
        "daily": stored(medallion.trips_daily_from_staging(trips, weather), "daily"),
        "zones": medallion.dim_zones(tables.zone_seed(spark, sf_dir)),
        "weather": weather,
    }
    return quality.run_suite(given, _suite())


# --- faults ---------------------------------------------------------------------------


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one bronze partition with file ordinals."""
    scan = tables.table(spark, sf_dir, "events").withColumn("part", F.lit("events"))
    numbered = faults.file_ordinals(scan, ["part"])
    return numbered.select(
        "event_id", F.col("user_id").alias("VendorID"), F.col("ts").alias("tpep_pickup_datetime"),
        F.col("value").alias("fare_amount"), "ordinal",
    )


@query
def fault_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.rename_trip_column(_numbered_events(spark, sf_dir).drop("ordinal"))


@query
def fault_weather_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = faults.rename_weather_column(tables.bronze_weather(spark, sf_dir))
    return rounded(renamed.select("date", faults.WEATHER_RENAME[1]))


@query
def fault_null_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.null_spike(_numbered_events(spark, sf_dir), F.col("ordinal"))


@query
def fault_volume_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.volume_drop(_numbered_events(spark, sf_dir), F.col("ordinal"))


@query
def fault_detection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault against every check, with the number of failures each check reports."""
    trips = _numbered_events(spark, sf_dir)
    weather = tables.bronze_weather(spark, sf_dir)
    ordinal = F.col("ordinal")
    expected_rows = F.lit(trips.count())
    variants = {
        "none": (trips, weather),
        "trip_schema_drift": (faults.rename_trip_column(trips), weather),
        "weather_schema_change": (trips, faults.rename_weather_column(weather)),
        "null_spike": (faults.null_spike(trips, ordinal), weather),
        "volume_drop": (faults.volume_drop(trips, ordinal), weather),
    }
    rows = []
    for fault, (t, w) in variants.items():
        wanted = {"VendorID", "tpep_pickup_datetime"} - set(t.columns)
        wanted |= {"date", faults.WEATHER_RENAME[0]} - set(w.columns)
        counted = t.agg(
            F.count_if(quality.is_missing("tpep_pickup_datetime")).alias("not_null"),
            F.when(F.count("*") < expected_rows * 0.9, 1).otherwise(0).cast("bigint").alias("row_count_tolerance"),
        ).withColumn("expected_columns", F.lit(len(wanted)).cast("bigint"))
        checks = F.array(
            *[
                F.struct(F.lit(fault).alias("fault"), F.lit(c).alias("check_name"), F.col(c).alias("failures"))
                for c in ("expected_columns", "not_null", "row_count_tolerance")
            ]
        )
        rows.append(counted.select(F.inline(checks)))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query
def dq_from_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and nulls of every column of every month of trips, from the statistics in the files' footers."""
    root = work_dir(spark, "footer-trips")
    trips = tables.trips_by_pickup_month(spark, sf_dir)
    gaps = {"tip_amount": F.col("VendorID") > 4, "DOLocationID": F.col("PULocationID") % 3 == 0}
    trips = trips.withColumns({c: F.when(~gap, F.col(c)) for c, gap in gaps.items()})
    files.write_partitions(trips, root, ["year", "month"])
    return quality.counts_from_footers(spark, root, trips.schema, ["year", "month"]).select(long("year"), long("month"), "column", "rows", "nulls")


# --- incidents ------------------------------------------------------------------------


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(tables.captured(spark, sf_dir).drop("recent_metadata"), "captured")


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, runs, captured incidents and their changes, each computed once."""
    events = stored(tables.events(spark, sf_dir), "events")
    runs = stored(tables.runs(spark, sf_dir, events), "runs")
    opened = stored(tables.captured(spark, sf_dir, events, runs).drop("recent_metadata"), "captured")
    return events, runs, opened, stored(tables.changes(spark, sf_dir, opened, events), "changes")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = _captured(spark, sf_dir)
    return stored(incidents.incident_state(opened, tables.changes(spark, sf_dir, opened)), "state")


@query
def capture_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.captured(spark, sf_dir).drop("recent_metadata")


def _trip_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row checks of staged trips with sample rows, told by an md5 that other systems know too."""
    trips = medallion.stage_trips(tables.bronze_trips(spark, sf_dir)).select("pickup_ts", "vendor_id", "pickup_zone_id", "dropoff_zone_id", "tip_amount", "total_amount")
    name = F.concat_ws("|", "pickup_zone_id", "dropoff_zone_id", "vendor_id", F.date_format("pickup_ts", "yyyyMMdd"))
    checks = [
        quality.RowCheck("tip_below_a_tenth", "stg_tlc_yellow", F.col("tip_amount") >= 0.1),
        quality.RowCheck("total_in_range", "stg_tlc_yellow", ~F.col("total_amount").between(20, 1_000_000)),
        quality.RowCheck("vendor_known", "stg_tlc_yellow", F.col("vendor_id") > 1_000),
    ]
    kept = trips.withColumn("_name", name)
    return quality.suite_samples(kept, checks, F.conv(F.substring(F.md5("_name"), 1, 15), 16, 10).cast("bigint"))


@query
def dq_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each check and up to three of the failing rows, by name."""
    names = F.array_sort(F.transform("sample_rows", lambda r: r["_name"]))
    return _trip_samples(spark, sf_dir).select("check_name", "failures", F.array_join(names, ",").alias("sample_names"))


@query
def incident_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents as full records: lineage, metadata with the run's tags, and sample rows of the asset's failed checks."""
    opened = stored(tables.captured(spark, sf_dir), "captured")
    nodes, edges = tables.incident_lineage(spark, sf_dir)
    lineage = context.neighbour_lists(context.lineage_neighbours(opened, nodes, edges))
    tags = tables.runs(spark, sf_dir).select("run_id", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("job_name"), F.lit("no"), F.lit("selected"), F.size("asset_keys").cast("string")).alias("tags"))
    records = incidents.full_records(opened, lineage, tags, _trip_samples(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("recent_metadata"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    names = F.array_sort(F.transform("sample_rows", lambda r: r["_name"]))
    return records.select("incident_id", joined("upstream_lineage"), F.array_join(entries, ";").alias("metadata"), F.array_join(names, ",").alias("sample_names"))


@query
def incident_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.state(spark, sf_dir).select("incident_id", "status", "resolved_at", "proposed_fix")


@query
def incident_state_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state from a snapshot of the first third of all changes and two appends of incidents and changes."""
    opened = _captured(spark, sf_dir)
    changes = stored(tables.changes(spark, sf_dir, opened), "changes")
    low, high = changes.agg(F.min("seq"), F.max("seq")).first()
    ends = [low + (high - low) // 3, low + (high - low) * 2 // 3, high]
    day = F.dayofmonth("created_at")
    snapshot = snapshots.start(opened.filter(day <= 10), changes.filter(F.col("seq") <= ends[0]))
    for days, end in ((day.between(11, 20), ends[1]), (day > 20, ends[2])):
        before, snapshot = snapshot, snapshots.advance(snapshot, opened.filter(days), changes.filter(F.col("seq") <= end))
        before.drop()
    return snapshot.state().select("incident_id", "status", "resolved_at", "proposed_fix")


@query
def open_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.summaries(incidents.open_incidents(tables.state(spark, sf_dir), 50))


@query
def incident_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.listing_line(incidents.open_incidents(tables.state(spark, sf_dir), 20))


@query
def append_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured incidents that a log of the first half of the month lacks."""
    opened = _captured(spark, sf_dir)
    log = opened.filter(F.dayofmonth("created_at") <= 15)
    return incidents.append_new(log, opened.unionByName(log)).select("incident_id", "created_at")


@query
def undiagnosed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.undiagnosed(tables.state(spark, sf_dir)).select("incident_id", "created_at", "asset_key")


@query
def diagnosis_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.diagnosis_queue(tables.state(spark, sf_dir), 10).select("incident_id", "created_at")


@query
def classify_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.classify(tables.captured(spark, sf_dir)).select("incident_id", "error_type", "category_hint")


@query
def incident_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their model reply as stored report, unreadable ones null."""
    state = tables.state(spark, sf_dir)
    reports = tables.responses(state).withColumnRenamed("response", "report")
    found = incidents.details(state, reports)
    return found.select("incident_id", "status", "error_message", "resolved_at", "incident_report")


# --- context --------------------------------------------------------------------------


@query
def lineage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.lineage_neighbours(*tables.lineage(spark, sf_dir))


@query
def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = context.neighbour_lists(lineage_neighbours(spark, sf_dir))
    return lists.select(
        bare_name(F.col("asset_key")).alias("name"), "upstream_count", "downstream_count", joined("upstream"),
        joined("downstream"),
    )


@query
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = stored(tables.runs(spark, sf_dir), "runs")
    ranked = context.recent_runs(_captured(spark, sf_dir), runs, 10)
    return ranked.select("asset_key", long("position"), "run_id", "status")


@query
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of every conversation, in full."""
    tails = context.log_tail(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)
    return tails.select("conv_id", F.size("log_lines").cast("bigint").alias("n_lines"), joined("log_lines", "\n"))


@query
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as incident texts; every third one has a prior fix, an empty one has none."""
    fix = F.when(F.col("doc_id") % 3 == 0, remediation.RETRY).when(F.col("doc_id") % 3 == 1, "")
    text = incidents.embedding_text(F.col("source"), F.col("lang"), F.col("text"), fix)
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.alias("embedding_text"))


@query
def incident_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of all documents; the rows report each vector's size and length."""
    documents = tables.table(spark, sf_dir, "documents")
    index = similarity.build_index(documents, "doc_id", "text")
    square = F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    weight = F.aggregate(F.transform("vector", lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return index.select(
        "doc_id", F.size("vector").cast("bigint").alias("dims"), F.round(F.sqrt(square), 3).alias("length"), F.round(weight, 3).alias("weight")
    )


@query
def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table after half of its labels were indexed again with doubled vectors."""
    index = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    doubled = F.transform("embedding", lambda x: x * F.lit(2).cast("float"))
    fresh = index.filter(F.col("label") < 5).withColumn("embedding", doubled)
    updated = similarity.upsert_index(index, fresh, "vec_id")
    millionths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string"))
    return updated.select("vec_id", long("label"), F.array_join(millionths, ",").alias("millionths"))


@query
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``upsert_vectors``, with the vectors kept as a bucketed table that the second batch is merged into, twice."""
    index = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    store = keyed_store.KeyedStore(spark, work_dir(spark, "vector-table"), index.schema, "vec_id")
    store.upsert(index)
    doubled = F.transform("embedding", lambda x: x * F.lit(2).cast("float"))
    for _ in range(2):
        store.upsert(index.filter(F.col("label") < 5).withColumn("embedding", doubled))
    millionths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string"))
    return store.read().select("vec_id", long("label"), F.array_join(millionths, ",").alias("millionths"))


def _similar(
    spark: SparkSession, sf_dir: str, state: DataFrame, queue: DataFrame, same_asset: bool, max_broadcast: int = similarity.BROADCAST_QUERIES
) -> DataFrame:
    """The queue's incidents against the vectors of every incident."""
    index = tables.incident_vectors(spark, sf_dir, state)
    wanted = index.join(queue.select(F.col("incident_id").alias("id")), "id", "left_semi")
    hits = similarity.similar_incidents(wanted, index, 5, same_asset=same_asset, exclude_self=True, max_broadcast=max_broadcast)
    return similarity.with_payload(hits, state)


def _tick_similar(spark: SparkSession, sf_dir: str, same_asset: bool) -> DataFrame:
    state = _state(spark, sf_dir)
    queue = incidents.diagnosis_queue(state, 10)
    return _similar(spark, sf_dir, state, queue, same_asset).withColumn("rank", long("rank"))


@query
def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick_similar(spark, sf_dir, True)


@query
def similar_any_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick_similar(spark, sf_dir, False)


@query
def similar_open_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar incidents for the whole undiagnosed queue, whatever its length, by the index of cells."""
    state = _state(spark, sf_dir)
    return _similar(spark, sf_dir, state, incidents.undiagnosed(state), True, max_broadcast=0).withColumn("rank", long("rank"))


def _context(
    spark: SparkSession, sf_dir: str, queue: DataFrame, similar: DataFrame | None = None, events: DataFrame | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Incidents of ``queue``, classified, with every context source; ``events`` and ``runs`` are stored ones, if there are any."""
    queue = incidents.classify(queue)
    nodes, edges = tables.incident_lineage(spark, sf_dir, events)
    neighbours = context.neighbour_lists(context.lineage_neighbours(queue, nodes, edges))
    runs = context.run_lists(context.recent_runs(queue, stored(tables.runs(spark, sf_dir, events), "runs") if runs is None else runs))
    log = tables.run_log(spark, sf_dir, events).withColumn("line", F.concat_ws(" ", "error_type", "error_message"))
    logs = context.log_tail(log, "run_id", "seq", "line", wanted=queue)
    return context.context_bundle(queue, neighbours, runs, logs, similar)


@query
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir)
    bundle = _full_context(spark, sf_dir, state, stored(incidents.undiagnosed(state), "queue"))
    return bundle.select(
        "incident_id",
        "asset_key",
        joined("upstream"),
        joined("downstream"),
        F.size("recent_runs").cast("bigint").alias("recent_run_count"),
        F.size("log_lines").cast("bigint").alias("log_line_count"),
        F.size("similar_incidents").cast("bigint").alias("similar_incident_count"),
    )


@query
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = stored(incidents.undiagnosed(_state(spark, sf_dir)), "queue")
    return diagnosis.build_prompts(_context(spark, sf_dir, queue))


@query
def tick_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of one tick's incidents, similar past incidents included."""
    state = _state(spark, sf_dir)
    queue = stored(incidents.diagnosis_queue(state, 10), "queue")
    similar = context.similar_lists(_similar(spark, sf_dir, state, queue, True))
    return diagnosis.build_prompts(_context(spark, sf_dir, queue, similar))


# --- diagnosis and remediation ----------------------------------------------------------


def _diagnosed(spark: SparkSession, sf_dir: str, opened: DataFrame | None = None) -> DataFrame:
    """All incidents with their diagnosis; ``opened`` are stored ones, if there are any."""
    opened = incidents.classify(_captured(spark, sf_dir) if opened is None else opened)
    return diagnosis.diagnose(opened, tables.responses(opened), remediation.ALLOWLIST)


@query
def validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply with its parsed fields or the reason it was rejected."""
    parsed = diagnosis.parse_responses(tables.responses(tables.captured(spark, sf_dir)))
    ok = F.col("error").isNull()
    fields = [F.when(ok, F.col(c)).alias(c) for c in diagnosis.DIAGNOSIS]
    return parsed.select("incident_id", *fields, "error")


@query
def diagnose_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).select("incident_id", "category_hint", *diagnosis.DIAGNOSIS, "diagnosis_error")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(tables.bronze_manifest(spark, sf_dir), "manifest")


def _decided(spark: SparkSession, sf_dir: str, opened: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    diagnosed = stored(_diagnosed(spark, sf_dir, opened), "diagnosed")
    return remediation.decide_actions(diagnosed, tables.flags(spark, sf_dir, events), _manifest(spark, sf_dir))


@query
def decide_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select(
        "incident_id", "action_status", "action_reason", "action", "description", "cleared_flag",
        F.col("next_run.partition_key").alias("next_partition"),
    )


def _full_context(spark: SparkSession, sf_dir: str, state: DataFrame, decided: DataFrame, events: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Decided incidents with every context source, similar incidents too."""
    decided = stored(decided, "decided")
    similar = context.similar_lists(_similar(spark, sf_dir, state, decided, True))
    return _context(spark, sf_dir, decided, similar, events, runs)


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The state, and reports of all incidents. Both are made from one capture; events are parsed and runs grouped once."""
    events, runs, opened, log = _recorded(spark, sf_dir)
    state = stored(incidents.incident_state(opened, log), "state")
    decided = _decided(spark, sf_dir, opened, events)
    return state, diagnosis.build_reports(_full_context(spark, sf_dir, state, decided, events, runs), NOW)


@query
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all incidents with their context, written by date and read back, looked up per incident."""
    root = work_dir(spark, "reports")
    files.write_reports(_reports(spark, sf_dir)[1], root)
    back = files.read_reports(spark, root)
    path = lambda p: F.get_json_object("report", f"$.{p}")
    return back.select(
        "incident_id",
        path("category_hint").alias("category_hint"),
        path("diagnosis.category").alias("category"),
        path("proposed_action.status").alias("action_status"),
        path("proposed_action.reason").alias("action_reason"),
        path("context_summary.upstream_count").cast("bigint").alias("upstream_count"),
        path("context_summary.recent_run_count").cast("bigint").alias("recent_run_count"),
        path("context_summary.similar_incident_count").cast("bigint").alias("similar_incident_count"),
        path("errors[0]").alias("first_error"),
    )


REPORT = T.StructType([T.StructField(c, T.StringType()) for c in ("incident_id", "generated_at", "report")])


def _report_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, keyed_store.KeyedStore]:
    """The state, and all reports, written three times: as they are, again, and as of a day before."""
    store = keyed_store.KeyedStore(spark, work_dir(spark, "report-store"), REPORT, "incident_id", ("generated_at", "report"))
    at = F.get_json_object("report", "$.generated_at")
    state, written = _reports(spark, sf_dir)
    built = stored(written.select("incident_id", at.alias("generated_at"), "report"), "built")
    for rows in (built, built, built.withColumns({"generated_at": F.lit("1970-01-01"), "report": F.lit("{}")})):
        store.upsert(rows)
    return state, store


def _report_fields() -> list[Column]:
    path = lambda p: F.get_json_object("report", f"$.{p}")
    return [F.col("incident_id"), path("category_hint").alias("category_hint"), path("diagnosis.category").alias("category"), path("proposed_action.status").alias("action_status")]


@query
def report_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports kept by incident: written again they stay one each, and an older one replaces none."""
    return _report_store(spark, sf_dir)[1].read().select(*_report_fields())


@query
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state and the report of one incident, the one with the largest id, read from its bucket."""
    state, store = _report_store(spark, sf_dir)
    wanted = state.agg(F.max("incident_id")).first()[0] or ""
    one = incidents.incident_by_id(state, wanted).select("incident_id", "status", "asset_key")
    return one.join(store.lookup(wanted).select(*_report_fields()), "incident_id")


@query
def second_tick_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still undiagnosed once the reports of one tick have stamped their fixes on the incident log."""
    events, runs, opened, log = _recorded(spark, sf_dir)
    state = stored(incidents.incident_state(opened, log), "state")
    queue = stored(incidents.classify(incidents.diagnosis_queue(state, 10)), "queue")
    diagnosed = diagnosis.diagnose(queue, tables.responses(queue), remediation.ALLOWLIST)
    decided = remediation.decide_actions(stored(diagnosed, "diagnosed"), tables.flags(spark, sf_dir, events), _manifest(spark, sf_dir))
    written = diagnosis.build_reports(_full_context(spark, sf_dir, state, decided, events, runs), NOW)
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).scalar()
    fixes = diagnosis.proposed_fixes(written, last + 1, F.lit(NOW).cast("timestamp_ntz"))
    after = incidents.state_after(state, stored(fixes.select(*log.columns), "fixes"))
    return incidents.undiagnosed(after).select("incident_id", "created_at")


@query
def flags_after_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags, and whether they are still raised after all decided actions."""
    before = tables.flags(spark, sf_dir)
    after = remediation.flags_after(before, _decided(spark, sf_dir)).withColumn("raised", F.lit(True))
    return before.join(after, "flag", "left").select("flag", F.coalesce("raised", F.lit(False)).alias("raised"))


@query
def tick_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decided(spark, sf_dir).withColumn("failed", F.col("diagnosis_error").isNotNull())
    return metrics.tick_summary(decided, ["asset_key"])


@query
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = _captured(spark, sf_dir)
    decided = remediation.decide_approvals(
        tables.approvals(spark, sf_dir, opened), opened, tables.flags(spark, sf_dir), _manifest(spark, sf_dir)
    )
    return decided.select("approval_id", "action", "status", "detail")


@query
def approved_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of incidents whose approval was applied, as the incident log has them afterwards."""
    opened = _captured(spark, sf_dir)
    decided = remediation.decide_approvals(
        tables.approvals(spark, sf_dir, opened), opened, tables.flags(spark, sf_dir), _manifest(spark, sf_dir)
    )
    log = tables.changes(spark, sf_dir, opened)
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).scalar()
    stamped = stored(remediation.approved_fixes(decided, last + 1, F.lit(NOW).cast("timestamp_ntz")), "stamped")
    after = incidents.incident_state(opened, log.unionByName(stamped.select(*log.columns)))
    return after.join(stamped.select("incident_id"), "incident_id", "left_semi").select("incident_id", "proposed_fix")


@query
def forced_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips landed twice: the second time only the months of quarantined partitions are replaced."""
    root = work_dir(spark, "forced")
    trips = tables.trips_by_pickup_month(spark, sf_dir)
    landing.land(trips, root)
    runs = _plan(spark, sf_dir, remediation.COERCE).filter("success").select("next_run.*")
    status = landing.land(trips, root, forced=stored(remediation.forced_partitions(runs), "forced-months"))
    kept = spark.read.parquet(root).groupBy("year", "month").agg(F.count("*").alias("stored_rows"))
    return status.join(kept, ["year", "month"], "full").select(long("year"), long("month"), "status", "rows", "stored_rows")


def _plan(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    opened = _captured(spark, sf_dir)
    return remediation.plan(opened, action, tables.flags(spark, sf_dir), _manifest(spark, sf_dir))


@query
def plan_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _plan(spark, sf_dir, remediation.RETRY)
    tags = F.col("next_run.run_tags")
    return plans.select(
        "incident_id", "asset_key", "partition_key", "description", "cleared_flag", F.size(tags).cast("bigint").alias("n_tags")
    )


@query
def retry_guard_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of the retry guard for every incident."""
    opened = tables.captured(spark, sf_dir)
    return opened.select(
        "incident_id", remediation.retry_guard().alias("loose"), remediation.retry_guard(strict=True).alias("strict")
    )


@query
def plan_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _plan(spark, sf_dir, remediation.SLIP)
    slipped_from = F.col("next_run.run_tags")[f"{remediation.TAG}.partition_slipped_from"]
    return plans.select(
        "incident_id",
        "success",
        "description",
        "action_error",
        F.col("next_run.partition_key").alias("next_partition"),
        slipped_from.alias("slipped_from"),
    )


@query
def plan_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, remediation.COERCE).select("incident_id", "success", "description", "quarantine_key")


@query
def coerce_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text copies of the planned trip partitions, written under the quarantine folder."""
    plans = _plan(spark, sf_dir, remediation.COERCE).filter(F.col("quarantine_key").contains("tlc"))
    bronze = tables.trips_by_pickup_month(spark, sf_dir)
    root = f"{work_dir(spark, 'bronze')}/_quarantine/tlc/yellow"
    rows = remediation.quarantine_rows(bronze, plans)
    files.write_partitions(rows, root, landing.KEYS)
    back = spark.read.schema(rows.schema).parquet(root)
    kept = ["tpep_pickup_datetime", "VendorID", "passenger_count", "PULocationID", "DOLocationID", "fare_amount"]
    return back.select(*kept, long("year"), long("month"))


@query
def rollback_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.rollback(_decided(spark, sf_dir))


@query
def rollback_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine objects left after undoing the plans of the weather asset."""
    plans = _plan(spark, sf_dir, remediation.COERCE).filter(F.col("quarantine_key").isNotNull())
    manifest = plans.select("quarantine_key", "bronze_rows").distinct()
    undone = remediation.rollback(plans.filter(F.col("asset_key").contains("weather")))
    return remediation.live_quarantine(manifest, undone)


@query
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned runs of incidents that are not resolved."""
    resolved = tables.state(spark, sf_dir).filter(F.col("status") == "resolved")
    return remediation.pending_runs(_decided(spark, sf_dir), resolved).select(
        "incident_id", "asset_key", "partition_key"
    )


# --- metrics --------------------------------------------------------------------------

HOUR = 3600


@query
def metric_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materializations per status in the last hour, every five minutes."""
    return metrics.increase(tables.metric_events(spark, sf_dir), ["status"], HOUR, 300)


@query
def metric_increase_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks by name in the last 24 hours, every hour."""
    failed = tables.metric_events(spark, sf_dir).filter(F.col("result") == "fail")
    return metrics.increase(failed, ["check_name"], 24 * HOUR, HOUR)


@query
def metric_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materializations per second by asset and status over five minutes."""
    return rounded(metrics.rate(tables.metric_events(spark, sf_dir), ["asset", "status"], 300, 60))


@query
def metric_rate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed rows per second by asset over five minutes."""
    return rounded(metrics.rate(tables.metric_events(spark, sf_dir), ["asset"], 300, 60, F.col("rows")))


@query
def metric_rate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check outcomes per second by name over ten minutes."""
    return rounded(metrics.rate(tables.metric_events(spark, sf_dir), ["check_name", "result"], 600, 60))


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.bucket_counts(tables.metric_events(spark, sf_dir), ["source"], "seconds")
    return counts.select("source", long("bucket"), "le", "cumulative")


@query
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 per source and day from the bucket counts."""
    events = tables.metric_events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    buckets = metrics.bucket_counts(events, ["source", "day"], "seconds")
    return rounded(metrics.histogram_quantile(buckets, ["source", "day"], 0.95))


@query
def latency_p95_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 per source and day, exact, and whether the estimate from the buckets lies in the same bucket."""
    events = tables.metric_events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    exact = metrics.exact_quantile(events, ["source", "day"], "seconds", 0.95)
    buckets = metrics.bucket_counts(events, ["source", "day"], "seconds")
    estimate = metrics.histogram_quantile(buckets, ["source", "day"], 0.95).withColumnRenamed("quantile", "estimate")
    bounds = [0.0, *metrics.LATENCY_BOUNDS]
    near = F.lit(False)
    for low, high in zip(bounds, bounds[1:]):
        near = near | (F.col("quantile").between(low, high) & F.col("estimate").between(low, high))
    near = near | ((F.col("quantile") >= bounds[-1]) & (F.col("estimate") == bounds[-1]))
    return exact.join(estimate, ["source", "day"]).select("source", "day", "quantile", near.alias("same_bucket"))


@query
def dq_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.metric_events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rounded(metrics.pass_rate(events, ["day"]))


@query
def top_failing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_failing(tables.metric_events(spark, sf_dir), 10)


@query
def latency_p95_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 per source in windows of five minutes."""
    start = F.window("ts", "5 minutes")["start"].alias("window_start")
    events = tables.metric_events(spark, sf_dir).select("source", "seconds", start)
    buckets = metrics.bucket_counts(events, ["source", "window_start"], "seconds")
    return rounded(metrics.histogram_quantile(buckets, ["source", "window_start"], 0.95))


@query
def dq_pass_rate_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rate of the last 24 hours of outcomes, those of the suite's runner among them."""
    return rounded(metrics.pass_rate(metrics.last_hours(_outcomes(spark, sf_dir), 24), ["check_name"]))


@query
def top_failing_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_failing(metrics.last_hours(_outcomes(spark, sf_dir), 24), 10)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of earlier checks and of one run of the suite, an hour after the last of them."""
    earlier = tables.metric_events(spark, sf_dir).select("ts", "check_name", "result")
    now = F.lit(earlier.agg(F.timestamp_add("HOUR", F.lit(1), F.max("ts"))).first()[0]).cast("timestamp_ntz")
    return earlier.unionByName(quality.suite_events(stored(dq_summary(spark, sf_dir), "summary"), now))


@query
def landing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.landing_totals(tables.metric_events(spark, sf_dir))


@query
def error_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.when(F.col("user_id") % 2 == 0, "worker-").otherwise("proxy-"), "user_id").alias("container"),
        F.concat_ws(" ", F.col("event_type"), F.col("props")).alias("line"),
    )
    return metrics.error_lines(lines, "worker.*|scheduler.*").select("event_id", "container", "line")


@query
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts of every user's hour with retryability and planned waits."""
    user, kind = F.col("user_id"), F.col("event_type")
    attempts = tables.table(spark, sf_dir, "events").select(
        F.concat_ws("-", user, F.date_format("ts", "yyyyMMdd")).alias("request"),
        "event_id",
        F.when(kind == "click", "timeout").when(kind == "view", "network").otherwise("status").alias("kind"),
        F.when(kind == "error", 503).when(kind == "signup", 429).when(kind == "purchase", 404).alias("status"),
    )
    retryable = retries.fetch_retryable(F.col("kind"), F.col("status"))
    planned = retries.retry_plan(
        attempts, "request", "event_id", retryable, retries.FETCH_ATTEMPTS, retries.FETCH_MAX_WAIT
    )
    return planned.select("request", "event_id", long("attempt"), "retryable", "exhausted", "wait_seconds")


@query
def model_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls of every user with the shorter policy."""
    names = F.array(*[F.lit(n) for n in [*retries.MODEL_RETRYABLE, "AuthenticationError"]])
    attempts = tables.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("request"),
        "event_id",
        F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("error_type"),
    )
    planned = retries.retry_plan(
        attempts, "request", "event_id", retries.model_retryable(F.col("error_type")), retries.MODEL_ATTEMPTS,
        retries.MODEL_MAX_WAIT,
    )
    return planned.select("request", "event_id", long("attempt"), "retryable", "exhausted", "wait_seconds")


@query
def late_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = metrics.sample_lateness(tables.metric_events(spark, sf_dir))
    return marked.groupBy("asset").agg(
        F.count_if("rejected").alias("rejected"), F.count_if(~F.col("rejected")).alias("accepted")
    )


# --- streaming ------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = tables.table(spark, sf_dir, "events").schema
    return jobs.file_stream(spark, sf_dir, schema, "events.parquet")


@query
def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed by month from a file stream; a second poll finds nothing new."""
    root, checkpoint = work_dir(spark, "stream-landing"), work_dir(spark, "checkpoint")
    keyed = _event_stream(spark, sf_dir).withColumns({"year": F.year("ts"), "month": F.month("ts")})
    for _ in range(2):
        jobs.landing_stream(keyed, root, checkpoint).awaitTermination()
    back = spark.read.parquet(root).groupBy("year", "month", "event_type")
    return back.agg(F.count("*").alias("rows")).select(long("year"), long("month"), "event_type", "rows")


@query
def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents captured by a stream over the log."""
    path = work_dir(spark, "stream-incidents")
    log = tables.log_lines(_event_stream(spark, sf_dir))
    jobs.incident_stream(log, path, work_dir(spark, "checkpoint")).awaitTermination()
    found = jobs.streamed_incidents(spark, path, tables.runs(spark, sf_dir))
    return found.select("incident_id", "asset_key", "error_type", "error_message", "stack_trace")


def _stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened_dir, path, checkpoint = (work_dir(spark, n) for n in ("opened", "stream-reports", "checkpoint"))
    opened = files.write_table(tables.captured(spark, sf_dir).drop("recent_metadata"), opened_dir)
    stream = jobs.file_stream(spark, opened_dir, opened.schema)
    flags, manifest, state = tables.flags(spark, sf_dir), _manifest(spark, sf_dir), _state(spark, sf_dir)
    gather = lambda decided: _full_context(spark, sf_dir, state, decided)
    for _ in range(2):
        jobs.diagnosis_stream(
            stream, tables.responses(opened), flags, manifest, NOW, path, checkpoint, gather
        ).awaitTermination()
    return spark.read.parquet(path)


@query
def stream_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with context written by a stream over opened incidents; a second tick writes none."""
    written = _stream_reports(spark, sf_dir)
    status = F.get_json_object("report", "$.proposed_action.status")
    return written.groupBy(status.alias("action_status")).agg(F.count("*").alias("n"))


@query
def stream_metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts over five minutes, every minute, from a stream."""
    path = work_dir(spark, "stream-metrics")
    end, events = work_dir(spark, "end-marker"), tables.table(spark, sf_dir, "events")
    files.write_table(jobs.end_marker(events), end)
    ended = _event_stream(spark, sf_dir).unionByName(jobs.file_stream(spark, end, events.schema))
    totals = jobs.window_totals(ended, ["event_type"], "5 minutes", "1 minute")
    jobs.metric_stream(totals, path, work_dir(spark, "checkpoint")).awaitTermination()
    return jobs.latest_windows(spark, path, ["event_type"])


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a stream accepts or rejects by their age on arrival."""
    path = work_dir(spark, "stream-late")
    k = F.get_json_object("props", "$.k").cast("int")
    samples = _event_stream(spark, sf_dir).withColumn("arrived_at", F.col("ts") + F.make_dt_interval(F.lit(0), k * 2))
    jobs.lateness_stream(samples, path, work_dir(spark, "checkpoint")).awaitTermination()
    written = spark.read.parquet(path)
    return written.groupBy("event_type", "rejected").agg(F.count("*").alias("n"))
