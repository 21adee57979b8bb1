"""Typing, validation and missing-data reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.rounding import rounded
from catalog.sessions_and_measures import ONE, SESSIONS, daily
from marketrisk.functions.lineage import ensure_checkpoint_dir
from marketrisk.plans import tables as tb
from marketrisk.sources import quality as q
from marketrisk.sources import readers, sinks
from marketrisk.sources import schema as sc


def master_schema(spark, sf):
    """Events completed to the 31-column minute table, with text columns typed."""
    rows = tb.sessions(spark, sf).drop("is_opx")
    text = F.when(F.col("event_id") % 9 == 0, "NA").when(F.col("event_id") % 9 == 1, "n/a")
    raw = rows.withColumns(
        {
            "umcsi": text.otherwise(F.col("ohlcv_volume").cast("string")),
            "is_weekly": F.when(F.col("event_id") % 4 == 0, "true").when(F.col("event_id") % 4 == 1, "None").otherwise("false"),
        }
    )
    full = sc.typed(sc.with_missing_columns(raw))
    return rounded(full.select("event_id", *[c for c in sc.MINUTE_SCHEMA.names if c != "timestamp"]))


def null_before(spark, sf):
    df = sc.null_before(tb.sessions(spark, sf), ["iex_bid_price"], "2024-01-10")
    return rounded(df.select("event_id", "iex_bid_price", "ohlcv_close"))


def early_null_share(spark, sf):
    df = sc.null_before(tb.sessions(spark, sf), ["iex_bid_price"], "2024-01-10")
    return rounded(q.early_null_share(df, "iex_", "2024-01-15"))


def order_violations(spark, sf):
    df = tb.table(spark, sf, "events")
    by_time = q.order_violations(df, "ts", "event_id").withColumn("of", F.lit("ts"))
    by_value = q.order_violations(df, "value", "event_id", per_bucket=1000).withColumn("of", F.lit("value"))
    keyed = q.order_violations(df, "value", "event_id", ["event_type"], 1000)
    return by_time.unionByName(by_value).unionByName(keyed.withColumnRenamed("event_type", "of"))


def duplicate_keys(spark, sf):
    return q.duplicates(tb.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_count(spark, sf):
    df = tb.table(spark, sf, "lineitem")
    return q.duplicate_count(df, ["l_orderkey", "l_linenumber"])


def completeness(spark, sf):
    return rounded(q.completeness(tb.sessions(spark, sf)))


def missing_report(spark, sf):
    df = q.missing_report(tb.sessions(spark, sf).drop("event_id"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rounded(df.select("column_name", "null_count", "null_pct", stamp("first_valid"), stamp("last_valid"), "overall_missing_pct"))


def worst_columns(spark, sf):
    df = q.worst_columns(q.missing_report(tb.sessions(spark, sf)))
    return rounded(df.select("column_name", "null_count", "null_pct"))


def monthly_missing(spark, sf):
    return q.monthly_missing(tb.sessions(spark, sf))


def usable_range(spark, sf):
    df = q.usable_range(tb.sessions(spark, sf), ["ohlcv_close", "early_close_minutes_local"])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select(stamp("start"), stamp("end"))


def fingerprint(spark, sf):
    return q.fingerprint(tb.sessions(spark, sf))


def mostly_missing(spark, sf):
    df = tb.sessions(spark, sf).select("ohlcv_close", "iex_bid_price", "early_close_minutes_local")
    return rounded(q.mostly_missing(df, 10.0))


def leak_probe(spark, sf):
    df = daily(spark, sf).withColumn("daily_close", F.round("daily_close", 1))
    return q.leak_probe(df, ONE)


def described(spark, sf):
    df = tb.table(spark, sf, "events").select(
        "user_id", F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("value")
    )
    return rounded(q.described(df), 6)


def _folder(spark, name):
    """A new folder under the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def minutes_written(spark, sf):
    """Events written as minute parquet and as CSV text, both read back as the typed minute table."""
    raw = tb.sessions(spark, sf).select("timestamp", "ohlcv_close", "ohlcv_volume", "iex_bid_price", "is_opx")
    parquet, text = _folder(spark, "minutes"), _folder(spark, "minutes-csv")
    raw.write.parquet(parquet)
    as_text = raw.withColumn("iex_bid_price", F.coalesce(F.col("iex_bid_price").cast("string"), F.lit("NA")))
    as_text.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.option("header", True).csv(text)
    first = readers.read_minutes(spark, parquet).withColumn("of", F.lit("parquet"))
    both = first.unionByName(readers.read_minutes_csv(spark, text).withColumn("of", F.lit("csv")))
    shape = both.groupBy("of", "is_opx").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("iex_bid_price").alias("bids"),
        F.sum("ohlcv_close").alias("close_sum"),
        F.count("eod_Close").alias("eod"),
    )
    return rounded(shape, 4)


def daily_written(spark, sf):
    """Daily bars and a side table through CSV, features through year-partitioned parquet, rejoined."""
    days = daily(spark, sf).select(F.col("session_date").alias("date"), F.col("daily_close").alias("close"), "daily_volume")
    side = tb.macro_days(spark, sf).select(F.col("day").alias("date"), F.col("cboe_VIXCLS").alias("close"))
    folder = _folder(spark, "daily")
    sinks.write_csv(days, f"{folder}/days")
    sinks.write_csv(side, f"{folder}/vix")
    back = readers.read_daily_csv(spark, f"{folder}/days", "date string, close double, daily_volume double")
    vix = readers.read_if_present(spark, f"{folder}/vix", "date string, close double")
    absent = readers.read_if_present(spark, f"{folder}/nothing", "date string, close double")
    joined = readers.with_side_tables(back, {"vix": vix, "sentiment": absent})
    sinks.write_features(joined, f"{folder}/features", date="date")
    return rounded(spark.read.parquet(f"{folder}/features").drop("year"), 7)


QUERIES = {
    f.__name__: f
    for f in (
        master_schema, null_before, early_null_share, order_violations, duplicate_keys, duplicate_count, completeness,
        missing_report, worst_columns, monthly_missing, usable_range, fingerprint, mostly_missing, leak_probe, described,
        minutes_written, daily_written,
    )
}

_DOUBLE_NULLS = [
    c
    for c in sc.MINUTE_SCHEMA.names
    if c not in ("timestamp", "ohlcv_close", "ohlcv_volume", "iex_bid_price", "umcsi", "early_close_minutes_local", *sc.FLAGS)
]
_COLS = ["timestamp", "ohlcv_close", "iex_bid_price", "ohlcv_volume", "is_early_close", "early_close_minutes_local", "is_opx"]


def _report(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) * 100 AS null_pct,"
        f" strftime(min(ts) FILTER ({c} IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS first_valid,"
        f" strftime(max(ts) FILTER ({c} IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS last_valid FROM ev"
        for c in columns
    )


EV = "ev AS (SELECT *, ts AS timestamp FROM stamped)"
_STAMPED = SESSIONS.split("sized AS")[0].rstrip().rstrip(",")

ORACLE = {
    "master_schema": S.ctes(_STAMPED)
    + S.final(
        "(SELECT event_id, ohlcv_close, ohlcv_volume, iex_bid_price, is_early_close, early_close_minutes_local,"
        " CASE WHEN event_id % 9 > 1 THEN ohlcv_volume END AS umcsi, event_id % 4 = 0 AS is_weekly,"
        " false AS is_holiday, false AS is_monthly_third_friday, false AS is_quarterly_eoq, false AS is_opx, "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in _DOUBLE_NULLS)
        + " FROM stamped)",
        "event_id, is_early_close, is_weekly, is_holiday, is_monthly_third_friday, is_quarterly_eoq, is_opx",
    ),
    "null_before": S.ctes(_STAMPED)
    + S.final(
        "(SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN iex_bid_price END AS iex_bid_price, ohlcv_close FROM stamped)",
        "event_id",
    ),
    "early_null_share": S.ctes(_STAMPED)
    + S.final(
        "(SELECT count(*) AS early_rows, avg(CAST(ts < TIMESTAMP '2024-01-10' OR iex_bid_price IS NULL AS INTEGER)) AS null_share"
        " FROM stamped WHERE ts < TIMESTAMP '2024-01-15')",
        "early_rows",
    ),
    "order_violations": """
WITH l AS (
  SELECT event_type, ts < lag(ts) OVER o AS a, value < lag(value) OVER o AS b,
         value < lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events WINDOW o AS (ORDER BY event_id))
SELECT 'ts' AS "of", count(*) AS rows, count(*) FILTER (a) AS violations FROM l
UNION ALL SELECT 'value', count(*), count(*) FILTER (b) FROM l
UNION ALL SELECT event_type, count(*), count(*) FILTER (c) FROM l GROUP BY event_type""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "duplicate_count": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"
    " AS duplicate_rows FROM lineitem",
    "completeness": S.ctes(_STAMPED)
    + S.final(
        "(SELECT *, null_share > 0.5 AS mostly_missing, null_share > 1 - 0.8 AS below_minimum FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, avg(CAST({c} IS NULL AS INTEGER)) AS null_share FROM stamped"
            for c in ("ohlcv_close", "iex_bid_price", "ohlcv_volume")
        )
        + "))",
        "column_name, mostly_missing, below_minimum",
    ),
    "missing_report": S.ctes(_STAMPED, EV, f"rp AS ({_report(_COLS)})")
    + S.final(
        f"(SELECT *, sum(null_count) OVER () / ((SELECT count(*) FROM ev) * {len(_COLS)}) * 100 AS overall_missing_pct FROM rp)",
        "column_name, null_count, first_valid, last_valid",
    ),
    "worst_columns": S.ctes(_STAMPED, EV, f"rp AS ({_report(_COLS)})")
    + S.final(
        "(SELECT column_name, null_count, null_pct FROM rp WHERE null_count > 0 ORDER BY null_pct DESC, column_name LIMIT 5)",
        "column_name, null_count",
    ),
    "monthly_missing": S.ctes(_STAMPED)
    + "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS total_count, 'ohlcv_' AS family, count(*) - count(ohlcv_close) AS null_count"
    " FROM stamped GROUP BY 1 UNION ALL SELECT strftime(ts, '%Y-%m'), count(*), 'iex_', count(*) - count(iex_bid_price)"
    " FROM stamped GROUP BY 1",
    "usable_range": S.ctes(_STAMPED)
    + "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM stamped"
    " WHERE ohlcv_close IS NOT NULL AND early_close_minutes_local IS NOT NULL",
    "fingerprint": "SELECT substr(md5(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') || '+00:00_' || strftime(max(ts),"
    " '%Y-%m-%d %H:%M:%S.%f') || '+00:00_' || count(*)), 1, 8) AS fingerprint, count(*) AS rows FROM events",
    "mostly_missing": S.ctes(_STAMPED)
    + S.final(
        "(SELECT column_name, missing_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 2) AS missing_pct FROM stamped"
            for c in ("ohlcv_close", "iex_bid_price", "early_close_minutes_local")
        )
        + ") WHERE missing_pct > 10)",
        "column_name",
    ),
    "leak_probe": S.ctes(
        S.DAILY,
        """
c AS (
  SELECT lag, lag_hit FROM (SELECT round(daily_close, 1) AS x, row_number() OVER (ORDER BY session_date) AS k FROM daily) a,
  LATERAL (SELECT CAST(i AS INTEGER) AS lag, (SELECT b.x FROM (SELECT round(daily_close, 1) AS x, n FROM daily) b
           WHERE b.n = a.k + i) = a.x AS lag_hit FROM range(1, 5) r(i)))""",
    )
    + "SELECT lag, count(*) FILTER (lag_hit) AS equal_rows FROM c GROUP BY lag",
    "minutes_written": S.ctes(_STAMPED)
    + S.final(
        "(SELECT o.x AS \"of\", is_opx, count(*) AS rows, count(iex_bid_price) AS bids, sum(ohlcv_close) AS close_sum,"
        " 0::BIGINT AS eod FROM stamped, (VALUES ('parquet'), ('csv')) o(x) GROUP BY 1, 2)",
        '"of", is_opx, rows, bids, eod',
        4,
    ),
    "daily_written": S.ctes(
        S.DAILY,
        f"vix AS (SELECT CAST(o_orderdate AS DATE) AS d, {S.six('avg(o_totalprice) / 12000')} AS v FROM orders GROUP BY 1)",
    )
    + S.final(
        "(SELECT session_date AS date, daily_close AS close, daily_volume, v AS close_vix FROM daily LEFT JOIN vix ON d = session_date"
        ")",
        "date",
        7,
    ),
    "described": """
WITH e AS (SELECT CAST(user_id AS DOUBLE) AS user_id, CASE WHEN user_id % 7 <> 0 THEN value END AS value FROM events)
"""
    + S.final(
        "("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,"
            f" max({c}) AS max, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,"
            f" quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM e"
            for c in ("user_id", "value")
        )
        + ")",
        "column_name, count, missing_count",
        6,
    ),
}
