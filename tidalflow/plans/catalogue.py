"""Every query by name, with its SQL twin. Figures are rounded to six decimals on both sides, as sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import book, panel, positions, regression, synchronization
from ..operators import quantiles as selection
from ..sources import calendar, events
from .sqltext import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The queries before figures are rounded, for those that build on others.
_EXACT: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SYMBOLS = [f"A{i}" for i in range(events.ASSETS)]
MAJOR, FIVE = SYMBOLS[:2], SYMBOLS[:5]
INTERVAL, SLOTS = "6 hours", 4
START, SPLIT, END = "2024-01-01", "2024-01-16", "2024-01-31"
DEVELOPMENT, OOS = (START, SPLIT), (SPLIT, END)


def query(body: str | None = None, *needs: str, f: str = ""):
    """Registers a query; ``body`` is its SQL behind the pieces ``needs``; ``f`` names the columns that are rounded."""
    figures = f.split()

    def register(make):
        def run(spark: SparkSession, root: str) -> DataFrame:
            df = make(spark, root)
            return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in figures}) if figures else df

        run.__doc__ = make.__doc__
        QUERIES[make.__name__], _EXACT[make.__name__] = run, make
        if body:
            inner = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in figures)}) FROM ({body})" if figures else body
            ORACLE[make.__name__] = sql(inner, *needs)
        return run

    return register


def _events(spark, root, *columns):
    return events.read(spark, root, "events", *(columns or ("event_id", "ts", "user_id", "event_type", "value", "props")))


def _trades(spark, root):
    return events.trades(_events(spark, root, "event_id", "ts", "user_id", "value", "props"))


def _kept(df: DataFrame) -> DataFrame:
    """Persisted: a panel has a row for each asset and bucket, so it is as large as its calendar, not as its trades; later operators read it many times."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _buckets(spark, root):
    return panel.trade_buckets(_trades(spark, root), INTERVAL)


def _features(spark, root):
    return panel.spot_features(_buckets(spark, root), events.ASSETS, DEVELOPMENT, OOS)


def _residuals(spark, root):
    x = _kept(_features(spark, root))
    return _kept(regression.residualized_two(x, "aggressor_imbalance", "own_return", "loo_market_return"))


def _oos(spark, root):
    return _residuals(spark, root).where("sample_split = 'oos'").select("bucket_start", "symbol", "residual_z")


def _flows(spark, root):
    """bucket_start, sample_split, major_flow, alt_flow, five_flow: group means, standardised on the development split."""
    major = F.col("symbol").isin(MAJOR)
    raw = _residuals(spark, root).groupBy("bucket_start").agg(F.any_value("sample_split").alias("sample_split"), F.avg(F.when(major, F.col("residual_z"))).alias("major"), F.avg(F.when(~major, F.col("residual_z"))).alias("alt"), F.avg(F.when(F.col("symbol").isin(FIVE), F.col("residual_z"))).alias("five"))
    dev = F.col("sample_split") == "development"
    scale = raw.agg(*(x(F.when(dev, F.col(c))).alias(f"{c}_{n}") for c in ("major", "alt", "five") for n, x in (("c", F.avg), ("s", F.stddev_samp))))
    return _kept(raw.crossJoin(F.broadcast(scale)).select("bucket_start", "sample_split", *(((F.col(c) - F.col(f"{c}_c")) / F.col(f"{c}_s")).alias(f"{c}_flow") for c in ("major", "alt", "five"))))


def _oos_flows(spark, root):
    return _flows(spark, root).where("sample_split = 'oos'")


def _design(spark, root, back=False, same_day=False):
    source, target = ("alt_flow", "major_flow") if back else ("major_flow", "alt_flow")
    return regression.lead_design(_oos_flows(spark, root), source, target, 1, same_day)


def _both(spark, root):
    return _design(spark, root).withColumn("direction", F.lit("major_to_alt")).unionByName(_design(spark, root, back=True).withColumn("direction", F.lit("alt_to_major")))


def _blocked(spark, root):
    return _kept(synchronization.blocks(_oos(spark, root), SLOTS, "month"))


def _offsets(blocked, draws=20):
    """Shifts by a rule, so that SQL can have the same."""
    one = blocked.select("block", "symbol", "days").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return one.select("draw", "block", "symbol", (3 + (F.col("draw") * 7 + F.substring("symbol", 2, 2).cast("int") * 3) % (F.col("days") - 5)).cast("int").alias("offset"))


def _futures(spark, root, taker="mean"):
    return _kept(panel.futures_buckets(events.futures_metrics(_events(spark, root)), INTERVAL, taker))


def _messages(spark, root):
    return events.book_messages(_events(spark, root))


def _sampled(spark, root):
    day = F.to_date("ts")  # books are ordered by time here, so days are parts of that order
    e = book.epochs(_messages(spark, root), day)
    return e, book.samples(e, 6 * 3600, day)


def _minutes(spark, root):
    e, s = _sampled(spark, root)
    return book.top(book.as_of(e, s), s)


def _venues(spark, root):
    """bucket_start, symbol, venue, flow on the full grid; cells without trades are 0."""
    cells = panel.trade_buckets(events.venue_trades(_events(spark, root, "event_id", "ts", "user_id", "value", "props")), INTERVAL, "venue").select("bucket_start", "symbol", "venue", F.col("aggressor_imbalance").alias("flow"))
    grid = calendar.spine(spark, START, END, INTERVAL).select("bucket_start", F.explode(F.array(*map(F.lit, SYMBOLS))).alias("symbol")).select("*", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("venue"))
    return _kept(grid.join(cells, ["bucket_start", "symbol", "venue"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0))).withColumn("sample_split", panel.sample_split(F.col("bucket_start"), DEVELOPMENT, OOS)))


def _common(spark, root):
    raw = _venues(spark, root).groupBy("bucket_start", "venue").agg(F.any_value("sample_split").alias("sample_split"), F.avg("flow").alias("m"))
    z = regression.standardised(raw, "m", "z", ["venue"], F.col("sample_split") == "development")
    side = lambda v: F.max(F.when(F.col("venue") == v, F.col("z"))).alias(f"{v}_flow")
    return _kept(z.groupBy("bucket_start").agg(F.any_value("sample_split").alias("sample_split"), side("first"), side("second")))


def _jobs(spark):
    return calendar.jobs(spark, START, "2024-02-01", SYMBOLS)


def _progress(spark, root):
    """A progress table by rule: what a collector would have written for the days before the 20th."""
    e = _events(spark, root, "event_id", "ts", "user_id").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    first = F.min("event_id")
    status = F.when(first % 5 == 0, "unavailable").when(first % 5 == 1, "failed").otherwise("complete")
    return e.groupBy(F.to_date("ts").alias("date"), F.concat(F.lit("A"), F.col("user_id") % events.ASSETS).alias("symbol")).agg(status.alias("status"), ((F.count("*") % 3 != 0) & (first % 5 > 1)).alias("quality_passed"), F.max("ts").alias("completed_at"))


# --- buckets, scans and projections ------------------------------------------------------------------------------------

_BUCKET = "bucket_start symbol first_timestamp last_timestamp first_price last_price transaction_count total_quantity total_quote_quantity buy_quote_quantity sell_quote_quantity bucket_return aggressor_imbalance".split()


@query(f"SELECT {', '.join(_BUCKET)} FROM buckets", "buckets", f="first_price last_price total_quantity total_quote_quantity buy_quote_quantity sell_quote_quantity bucket_return aggressor_imbalance")
def trade_buckets(spark, root):
    return _buckets(spark, root).select(_BUCKET)


@query("SELECT symbol, trade_id, side, price, size, ts FROM trades", "trades")
def scan_project(spark, root):
    return _trades(spark, root).select("symbol", "trade_id", "side", "price", "size", "ts")


@query("SELECT symbol, trade_id, price FROM trades WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'", "trades")
def time_range_filter(spark, root):
    at = F.col("ts")
    return _trades(spark, root).where((at >= F.lit("2024-01-05").cast("timestamp_ntz")) & (at < F.lit("2024-01-08").cast("timestamp_ntz"))).select("symbol", "trade_id", "price")


@query("SELECT bucket_start, symbol, transaction_count FROM buckets WHERE bucket_start >= TIMESTAMP '2024-01-05' AND bucket_start < TIMESTAMP '2024-01-08'", "buckets")
def bucket_range_filter(spark, root):
    at = F.col("bucket_start")
    return _buckets(spark, root).where((at >= F.lit("2024-01-05").cast("timestamp_ntz")) & (at < F.lit("2024-01-08").cast("timestamp_ntz"))).select("bucket_start", "symbol", "transaction_count")


@query("SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k, props->>'$.k' IS NULL AS failed FROM events")
def json_decode(spark, root):
    k = F.from_json("props", "k double")["k"]
    return _events(spark, root, "event_id", "props").select("event_id", k.alias("k"), k.isNull().alias("failed"))


@query("SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 18 HOUR, INTERVAL 6 HOUR))::TIMESTAMP AS bucket_start FROM events")
def calendar_spine(spark, root):
    """Of the days from the first event's to the last one's."""
    return calendar.spine_of(_events(spark, root, "ts"), "ts", INTERVAL)


@query("SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM orders")
def month_spine(spark, root):
    """Of the months in which there are orders."""
    return calendar.months_of(spark.read.parquet(f"{root}/orders.parquet"), "o_orderdate")


@query("SELECT d::DATE AS date, symbol FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS d FROM events) JOIN (SELECT DISTINCT symbol FROM trades) ON true", "trades")
def job_cross_join(spark, root):
    """Each day that events span with each symbol that trades have."""
    return calendar.jobs_of(_trades(spark, root), "ts")


@query("SELECT bucket_start, symbol, venue, flow FROM venues", "venues", f="flow")
def venue_panels(spark, root):
    return _venues(spark, root).select("bucket_start", "symbol", "venue", "flow")


@query("SELECT trade_id, symbol, CASE WHEN side = 'buy' THEN price * size ELSE -price * size END AS signed_flow FROM trades", "trades", f="signed_flow")
def signed_flow(spark, root):
    quote = F.col("price") * F.col("size")
    return _trades(spark, root).select("trade_id", "symbol", F.when(F.col("side") == "buy", quote).otherwise(-quote).alias("signed_flow"))


@query("SELECT bucket_start, symbol, sample_split FROM features", "features")
def sample_split(spark, root):
    return _features(spark, root).select("bucket_start", "symbol", "sample_split")


@query("SELECT bucket_start, symbol FROM features WHERE sample_split = 'oos' AND symbol = 'A3'", "features")
def split_filter(spark, root):
    return _features(spark, root).where("sample_split = 'oos' AND symbol = 'A3'").select("bucket_start", "symbol")


_FEATURE = "own_return loo_market_return abs_own_return abs_loo_market_return log_quote_volume log_transaction_count hour_sin hour_cos"


@query(f"SELECT bucket_start, symbol, weekday, sample_split, {', '.join(_FEATURE.split())} FROM features", "features", f=_FEATURE)
def features(spark, root):
    return _features(spark, root).select("bucket_start", "symbol", F.col("weekday").cast("long").alias("weekday"), "sample_split", *_FEATURE.split())


@query("SELECT bucket_start, symbol, loo_market_return FROM features", "features", f="loo_market_return")
def loo_return(spark, root):
    return panel.leave_one_out(_buckets(spark, root), "bucket_return", "loo_market_return", events.ASSETS).select("bucket_start", "symbol", "loo_market_return")


@query(f"SELECT bucket_start, symbol, 1.0::DOUBLE AS const, {', '.join(_FEATURE.split())}, {', '.join(f'(weekday = {d})::INT::DOUBLE AS weekday_{d}' for d in range(1, 7))} FROM features", "features", f=_FEATURE)
def design_matrix(spark, root):
    names = ["const", *panel.DESIGN, *(f"weekday_{d}" for d in range(1, 7))]
    x = _features(spark, root)
    return x.select("bucket_start", "symbol", *(c.alias(n) for c, n in zip(panel.design(x), names, strict=True)))


@query("SELECT user_id, event_id FROM events WHERE event_type IN ('click', 'view')")
def membership(spark, root):
    return _events(spark, root, "user_id", "event_id", "event_type").where(F.col("event_type").isin("click", "view")).select("user_id", "event_id")


@query("SELECT bucket_start, symbol, open_interest, log_oi_change FROM oi WHERE open_interest IS NOT NULL AND log_oi_change IS NOT NULL", "oi", f="open_interest log_oi_change")
def complete_case(spark, root):
    return panel.log_change(_futures(spark, root), "open_interest", "log_oi_change").select("bucket_start", "symbol", "open_interest", "log_oi_change").dropna(how="any")


@query("SELECT bucket_start, major_flow FROM oos_flows WHERE abs(major_flow) >= (SELECT quantile_cont(abs(major_flow), 0.9) FROM flows WHERE sample_split = 'development')", "oos_flows", f="major_flow")
def extreme_events_ge(spark, root):
    flows = _flows(spark, root)
    edge = flows.where("sample_split = 'development'").agg(F.percentile(F.abs("major_flow"), 0.9).alias("edge"))
    return flows.where("sample_split = 'oos'").crossJoin(F.broadcast(edge)).where(F.abs("major_flow") >= F.col("edge")).select("bucket_start", "major_flow")


_EDGES = "(SELECT quantile_cont(abs(first_flow), 0.9) AS e1, quantile_cont(abs(second_flow), 0.9) AS e2 FROM common WHERE sample_split = 'development')"


def _edged(spark, root):
    c = _common(spark, root)
    edges = c.where("sample_split = 'development'").agg(F.percentile(F.abs("first_flow"), 0.9).alias("e1"), F.percentile(F.abs("second_flow"), 0.9).alias("e2"))
    return c.where("sample_split = 'oos'").crossJoin(F.broadcast(edges))


@query(f"SELECT bucket_start, first_flow, second_flow FROM common, {_EDGES} WHERE sample_split = 'oos' AND (abs(first_flow) > e1 OR abs(second_flow) > e2)", "common", f="first_flow second_flow")
def extreme_events_or(spark, root):
    return _edged(spark, root).where((F.abs("first_flow") > F.col("e1")) | (F.abs("second_flow") > F.col("e2"))).select("bucket_start", "first_flow", "second_flow")


# --- joins and sets ----------------------------------------------------------------------------------------------------


@query("SELECT bucket_start, five_flow, taker FROM flows JOIN (SELECT bucket_start, avg(taker_direction) AS taker FROM futures GROUP BY 1) USING (bucket_start)", "flows", "futures", f="five_flow taker")
def inner_time_join(spark, root):
    taker = _futures(spark, root).groupBy("bucket_start").agg(F.avg("taker_direction").alias("taker"))
    return _flows(spark, root).join(taker, "bucket_start").select("bucket_start", "five_flow", "taker").dropna()


@query("SELECT bucket_start, five_flow, m FROM oos_flows LEFT JOIN (SELECT bucket_start, avg(abs(log_oi_change)) AS m FROM oi GROUP BY 1) USING (bucket_start)", "oos_flows", "oi", f="five_flow m")
def left_time_join(spark, root):
    oi = panel.log_change(_futures(spark, root), "open_interest", "change").groupBy("bucket_start").agg(F.avg(F.abs("change")).alias("m"))
    return _oos_flows(spark, root).join(oi, "bucket_start", "left").select("bucket_start", "five_flow", "m")


@query("SELECT g.ts AS bucket_start, 'A' || a AS symbol FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01 18:00:00', INTERVAL '6 hours') g(ts), range(7) t(a) WHERE NOT EXISTS (SELECT 1 FROM buckets b WHERE b.bucket_start = g.ts AND b.symbol = 'A' || a)", "buckets")
def grid_gaps(spark, root):
    return panel.grid_gaps(_buckets(spark, root), calendar.spine(spark, START, "2024-02-02", INTERVAL), SYMBOLS)


@query("SELECT bucket_start, symbol FROM buckets WHERE bucket_start IN (SELECT bucket_start FROM buckets GROUP BY 1 HAVING count(DISTINCT symbol) = 7)", "buckets")
def intersection_semi(spark, root):
    b = _buckets(spark, root)
    return b.join(panel.complete_buckets(b, events.ASSETS), "bucket_start", "left_semi").select("bucket_start", "symbol")


@query("SELECT bucket_start FROM buckets GROUP BY 1 HAVING count(DISTINCT symbol) = 7", "buckets")
def intersect_ts(spark, root):
    return panel.complete_buckets(_buckets(spark, root), events.ASSETS)


@query("SELECT bucket_start::DATE AS day FROM design INTERSECT SELECT bucket_start::DATE FROM back_design", "design", "back_design")
def intersect_days(spark, root):
    day = lambda d: d.select(F.to_date("bucket_start").alias("day"))
    return day(_design(spark, root)).intersect(day(_design(spark, root, back=True)))


@query("SELECT date, symbol FROM jobs EXCEPT SELECT date, symbol FROM progress", "jobs", "progress")
def except_keys(spark, root):
    return _jobs(spark).subtract(_progress(spark, root).select("date", "symbol"))


@query("SELECT date, symbol FROM jobs ANTI JOIN (SELECT * FROM progress WHERE status IN ('complete', 'unavailable')) USING (date, symbol)", "jobs", "progress")
def pending_anti(spark, root):
    from ..operators import collection

    return collection.pending(_jobs(spark), _progress(spark, root))


@query("SELECT date, symbol FROM (SELECT * FROM jobs ANTI JOIN (SELECT * FROM progress WHERE status IN ('complete', 'unavailable')) USING (date, symbol)) ORDER BY date, symbol LIMIT 25", "jobs", "progress")
def pending_limit(spark, root):
    """The limit is the operator's own: at most so many new files a run."""
    return _EXACT["pending_anti"](spark, root).orderBy("date", "symbol").limit(25)


@query("SELECT * FROM (SELECT date, symbol, status FROM progress WHERE symbol <> 'A0' UNION ALL SELECT DISTINCT date, symbol, 'complete' FROM progress WHERE symbol = 'A0')", "progress")
def upsert(spark, root):
    old = _progress(spark, root).select("date", "symbol", "status")
    new = old.where("symbol = 'A0'").withColumn("status", F.lit("complete")).distinct()
    from ..operators import collection

    return collection.upserted(old, new)


@query("SELECT b.date, symbol, n FROM (SELECT bucket_start::DATE AS date, symbol, count(*) AS n FROM buckets GROUP BY 1, 2) b SEMI JOIN (SELECT * FROM progress WHERE quality_passed) USING (date, symbol)", "buckets", "progress")
def quality_semi_join(spark, root):
    days = _buckets(spark, root).groupBy(F.to_date("bucket_start").alias("date"), "symbol").agg(F.count("*").alias("n"))
    return days.join(_progress(spark, root).where("quality_passed"), ["date", "symbol"], "left_semi")


@query("SELECT bucket_start, symbol, venue, flow FROM venues WHERE venue = 'first' UNION ALL SELECT bucket_start, symbol, venue, flow FROM venues WHERE venue = 'second'", "venues", f="flow")
def union_all(spark, root):
    v = _venues(spark, root).select("bucket_start", "symbol", "venue", "flow")
    return v.where("venue = 'first'").unionByName(v.where("venue = 'second'"))


@query("SELECT DISTINCT bucket_start, sample_split FROM features", "features")
def distinct_split(spark, root):
    return _features(spark, root).select("bucket_start", "sample_split").distinct()


_WIDE = ", ".join(f"max(bucket_return) FILTER (symbol = '{s}') AS {s}" for s in SYMBOLS)


@query(f"SELECT bucket_start, {_WIDE} FROM buckets GROUP BY 1", "buckets", f=" ".join(SYMBOLS))
def pivot_panel(spark, root):
    return _buckets(spark, root).groupBy("bucket_start").pivot("symbol", SYMBOLS).agg(F.max("bucket_return"))


@query("SELECT bucket_start, symbol, bucket_return FROM buckets", "buckets", f="bucket_return")
def unpivot_panel(spark, root):
    wide = _buckets(spark, root).groupBy("bucket_start").pivot("symbol", SYMBOLS).agg(F.max("bucket_return"))
    return wide.unpivot("bucket_start", SYMBOLS, "symbol", "bucket_return").where("bucket_return IS NOT NULL")


@query("SELECT bucket_start, symbol, transaction_count FROM buckets ORDER BY bucket_start, symbol", "buckets")
def sorted_panel(spark, root):
    return _buckets(spark, root).select("bucket_start", "symbol", "transaction_count").orderBy("bucket_start", "symbol")


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, count(DISTINCT (bucket_start, symbol)) AS unique_keys, count(DISTINCT bucket_start) AS timestamps, count(DISTINCT symbol) AS symbols, min(bucket_start) AS first_bucket, max(bucket_start) AS last_bucket, bool_and(abs(aggressor_imbalance) <= 1 + 1e-12) AS imbalance_in_bounds, count(*) FILTER (bucket_return IS NULL) AS missing_returns FROM buckets", "buckets")
def coverage(spark, root):
    return panel.coverage(_buckets(spark, root))


@query("SELECT venue, count(*) AS rows, count(DISTINCT bucket_start) AS timestamps, count(DISTINCT symbol) AS symbols, count(*) FILTER (flow = 0) AS zero_cells FROM venues GROUP BY 1", "venues")
def venue_coverage(spark, root):
    return _venues(spark, root).groupBy("venue").agg(F.count("*").alias("rows"), F.count_distinct("bucket_start").alias("timestamps"), F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("flow") == 0).alias("zero_cells"))


@query("SELECT symbol, count(*) / 120.0::DOUBLE AS share, (SELECT count(*) / 120.0::DOUBLE FROM (SELECT bucket_start FROM buckets GROUP BY 1 HAVING count(DISTINCT symbol) = 7)) AS common_share FROM buckets GROUP BY 1", "buckets", f="share common_share")
def intersection_coverage(spark, root):
    b = _buckets(spark, root)
    total = calendar.spine(spark, START, END, INTERVAL).agg(F.count("*").alias("total"))
    common = panel.complete_buckets(b, events.ASSETS).agg(F.count("*").alias("common"))
    return b.groupBy("symbol").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(common)).select("symbol", (F.col("n") / F.col("total")).alias("share"), (F.col("common") / F.col("total")).alias("common_share"))


@query("SELECT min(n / 19.0::DOUBLE) AS share FROM (SELECT 'A' || a AS symbol, (SELECT count(*) FROM progress p WHERE p.symbol = 'A' || a AND quality_passed) AS n FROM range(8) t(a))", "progress", f="share")
def valid_day_share(spark, root):
    """Symbols without a valid day count as 0: A7 has none."""
    have = _progress(spark, root).where("quality_passed").groupBy("symbol").agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, [*SYMBOLS, "A7"]))).alias("symbol"))
    return every.join(have, "symbol", "left").agg(F.min(F.coalesce("n", F.lit(0)) / 19).alias("share"))


@query("SELECT source_rows, count(*) AS buckets, count(*) / sum(count(*)) OVER () AS share FROM futures GROUP BY 1", "futures", f="share")
def value_counts_share(spark, root):
    n = _futures(spark, root).groupBy("source_rows").agg(F.count("*").alias("buckets"))
    total = n.agg(F.sum("buckets").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("source_rows", "buckets", (F.col("buckets") / F.col("total")).alias("share"))


@query(
    """SELECT design, days, gb AS estimated_compressed_gb FROM (SELECT avg(mb) AS a, median(mb) AS m FROM (SELECT ts::DATE AS d, sum(value) AS mb FROM events WHERE event_type <> 'error' AND event_id % 10 <> 3 GROUP BY 1)),
  LATERAL (VALUES ('sampled_catalog_day', 1, a / 1000), ('bounded_confirmatory_window', 180, a * 180 / 1000), ('full_two_year_window', 730, a * 730 / 1000), ('sampled_catalog_day_median', 1, m / 1000)) v(design, days, gb)""",
    f="estimated_compressed_gb",
)
def resource_estimate(spark, root):
    """Events as a catalogue: errors are files that aren't there, and every tenth has no known size."""
    from ..operators import collection

    e = _events(spark, root, "ts", "value", "event_type", "event_id")
    catalog = e.select(F.to_date("ts").alias("date"), (F.col("event_type") != "error").alias("available"), F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("size_mb"))
    return collection.resources(catalog, 180, 730)


@query("SELECT bucket_start, sample_split, major_flow, alt_flow, five_flow FROM flows", "flows", f="major_flow alt_flow five_flow")
def composites(spark, root):
    return _flows(spark, root)


@query("SELECT bucket_start, sample_split, first_flow, second_flow FROM common", "common", f="first_flow second_flow")
def common_flow(spark, root):
    return _common(spark, root)


@query("SELECT bucket_start, symbol, residual_z FROM z", "z", f="residual_z")
def dev_zscore(spark, root):
    return _residuals(spark, root).select("bucket_start", "symbol", "residual_z")


@query("SELECT symbol, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.95) AS p95, quantile_cont(size, 0.99) AS p99 FROM trades GROUP BY 1", "trades", f="p50 p95 p99")
def quantiles(spark, root):
    found = selection.exact_quantiles(_trades(spark, root), "size", [0.5, 0.95, 0.99], ["symbol"])
    return found.groupBy("symbol").agg(*(F.max(F.when(F.col("p") == p / 100, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)))


@query("SELECT left_symbol, right_symbol, correlation FROM pairs", "pairs", f="correlation")
def pairwise_corr(spark, root):
    return synchronization.pairwise_corr(_oos(spark, root), "residual_z")


@query("SELECT left_symbol, right_symbol, correlation FROM pairs UNION ALL SELECT right_symbol, left_symbol, correlation FROM pairs UNION ALL SELECT 'A' || a, 'A' || a, 1.0 FROM range(7) t(a)", "pairs", f="correlation")
def corr_matrix(spark, root):
    return synchronization.corr_matrix(synchronization.pairwise_corr(_oos(spark, root), "residual_z"), SYMBOLS)


@query("SELECT avg(correlation) AS mean_pairwise_correlation FROM pairs", "pairs", f="mean_pairwise_correlation")
def mean_pairwise_corr(spark, root):
    return synchronization.pairwise_corr(_oos(spark, root), "residual_z").agg(F.avg("correlation").alias("mean_pairwise_correlation"))


@query("SELECT avg(c) AS mean_same_asset_correlation FROM (SELECT a.symbol, corr(a.flow, b.flow) AS c FROM venues a JOIN venues b ON a.bucket_start = b.bucket_start AND a.symbol = b.symbol AND a.venue = 'first' AND b.venue = 'second' WHERE a.sample_split = 'oos' GROUP BY 1)", "venues", f="mean_same_asset_correlation")
def same_asset_corr(spark, root):
    """One aggregate by cell instead of a self-join."""
    side = lambda v: F.max(F.when(F.col("venue") == v, F.col("flow"))).alias(v)
    cells = _venues(spark, root).where("sample_split = 'oos'").groupBy("bucket_start", "symbol").agg(side("first"), side("second"))
    return cells.groupBy("symbol").agg(F.corr("first", "second").alias("c")).agg(F.avg("c").alias("mean_same_asset_correlation"))


_MARKS = "(SELECT bucket_start, greatest(count(*) FILTER (residual_z > 0), count(*) FILTER (residual_z < 0)) AS most, avg(residual_z) AS m FROM oos GROUP BY 1)"


@query(f"SELECT avg((most >= 6)::INT) AS alignment_rate FROM {_MARKS}", "oos", f="alignment_rate")
def alignment_rate(spark, root):
    return synchronization.alignment(_oos(spark, root), "residual_z", 6).select("alignment_rate")


@query(f"SELECT avg(abs(m)) AS intensity FROM {_MARKS}", "oos", f="intensity")
def common_flow_intensity(spark, root):
    return synchronization.alignment(_oos(spark, root), "residual_z", 6).select("intensity")


@query(f"SELECT avg((sign(first_flow) = sign(second_flow))::INT) AS concordance, count(*) AS event_count FROM common, {_EDGES} WHERE sample_split = 'oos' AND (abs(first_flow) > e1 OR abs(second_flow) > e2)", "common", f="concordance")
def extreme_concordance(spark, root):
    return synchronization.concordance(_edged(spark, root), "first_flow", "second_flow", F.col("e1"), F.col("e2"))


@query("SELECT event_type, count(*) FILTER (open_interest IS NULL) AS missing_open_interest, count(*) AS rows FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS open_interest FROM events) GROUP BY 1")
def missing_counts(spark, root):
    oi = F.when(F.col("event_type") != "error", F.col("value"))
    return _events(spark, root, "event_type", "value").groupBy("event_type").agg(F.count_if(oi.isNull()).alias("missing_open_interest"), F.count("*").alias("rows"))


@query("SELECT corr(five_flow, m) AS correlation FROM oos_flows LEFT JOIN (SELECT bucket_start, avg(abs(log_oi_change)) AS m FROM oi GROUP BY 1) USING (bucket_start)", "oos_flows", "oi", f="correlation")
def oi_corr(spark, root):
    return _EXACT["left_time_join"](spark, root).agg(F.corr("five_flow", "m").alias("correlation"))


@query("SELECT bool_and(status <> 'failed') AS none_failed, bool_or(quality_passed) AS any_passed, count(*) AS rows FROM progress", "progress")
def gates(spark, root):
    return _progress(spark, root).agg(F.bool_and(F.col("status") != "failed").alias("none_failed"), F.bool_or("quality_passed").alias("any_passed"), F.count("*").alias("rows"))


@query(
    """SELECT count(*) AS completed_files, 217 AS total_files, count(*) / 217.0::DOUBLE AS progress_share, count(*) FILTER (quality_passed) AS quality_passing_files, count(*) FILTER (NOT quality_passed) AS quality_failing_files,
  count(*) FILTER (status = 'unavailable') AS unavailable_files, last(date ORDER BY completed_at, date, symbol) AS last_completed_date, last(symbol ORDER BY completed_at, date, symbol) AS last_completed_symbol FROM progress WHERE status IN ('complete', 'unavailable')""",
    "progress",
    f="progress_share",
)
def collection_state(spark, root):
    from ..operators import collection

    return collection.state(_jobs(spark), _progress(spark, root)).withColumn("total_files", F.col("total_files").cast("int"))


# --- windows -----------------------------------------------------------------------------------------------------------


@query("SELECT bucket_start, symbol, log_oi_change FROM oi", "oi", f="log_oi_change")
def log_oi_change(spark, root):
    return panel.log_change(_futures(spark, root), "open_interest", "log_oi_change").select("bucket_start", "symbol", "log_oi_change")


@query("SELECT bucket_start, symbol, -(ln(d) - lag(ln(d)) OVER (PARTITION BY symbol ORDER BY bucket_start)) AS depletion FROM (SELECT bucket_start, symbol, CASE WHEN top10_depth_quote > 0 THEN top10_depth_quote END AS d FROM liquid)", "liquid", f="depletion")
def depth_depletion(spark, root):
    return panel.log_change(book.liquidity(_minutes(spark, root), "1 day"), "top10_depth_quote", "depletion", -1).select("bucket_start", "symbol", "depletion")


@query("SELECT symbol, count(*) AS violations FROM (SELECT symbol, trade_id, lag(trade_id) OVER (PARTITION BY symbol, ts::DATE ORDER BY size, trade_id) AS before FROM trades) WHERE trade_id <= before GROUP BY 1", "trades")
def id_order_violations(spark, root):
    """Ids that fall, along an order that isn't theirs (size, within a day as within a file), so that there are some."""
    before = F.lag("trade_id").over(Window.partitionBy("symbol", F.to_date("ts")).orderBy("size", "trade_id"))
    return _trades(spark, root).withColumn("before", before).where("trade_id <= before").groupBy("symbol").agg(F.count("*").alias("violations"))


@query("SELECT bucket_start, y, x1, x2 FROM design", "design", f="y x1 x2")
def lead_lag_design(spark, root):
    return _design(spark, root)


@query("SELECT bucket_start, y, x1, x2 FROM design WHERE bucket_start::DATE = nxt::DATE", "design", f="y x1 x2")
def lead_same_day(spark, root):
    return _design(spark, root, same_day=True)


@query("SELECT bucket_start, five_flow, lag(five_flow) OVER (ORDER BY bucket_start) AS lagged FROM oos_flows", "oos_flows", f="five_flow lagged")
def futures_lag(spark, root):
    """The lag is taken after the restriction to the out-of-sample split."""
    placed = positions.numbered(_oos_flows(spark, root).select("bucket_start", "five_flow"), ["bucket_start"])
    return positions.behind(placed, "five_flow", "lagged").drop("position")


_P = "(SELECT symbol, event_type, (count(*) % 97 + 1) / 100.0::DOUBLE AS p FROM (SELECT 'A' || (user_id % 7) AS symbol, event_type FROM events) GROUP BY 1, 2)"


@query(
    f"SELECT symbol, event_type, p, least(1, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, symbol, event_type) AS r, count(*) OVER () AS n FROM {_P})",
    f="q",
)
def bh_fdr(spark, root):
    e = _events(spark, root, "user_id", "event_type").groupBy(F.concat(F.lit("A"), F.col("user_id") % 7).alias("symbol"), "event_type").agg(((F.count("*") % 97 + 1) / 100).alias("p"))
    return synchronization.benjamini_hochberg(e, "p", "q").select("symbol", "event_type", "p", "q")


@query("SELECT bucket_start, symbol, block, day, days, slot FROM sized", "sized")
def block_index(spark, root):
    return _blocked(spark, root).select("bucket_start", "symbol", "block", F.col("day").cast("long").alias("day"), "days", F.col("slot").cast("long").alias("slot"))


@query("SELECT draw, bucket_start, symbol, shifted FROM moved", "moved", f="shifted")
def circular_shift(spark, root):
    b = _blocked(spark, root)
    return synchronization.shifted(b, _offsets(b), "residual_z").select(F.col("draw").cast("long").alias("draw"), "bucket_start", "symbol", "shifted")


@query("SELECT f.draw, o.bucket_start, o.symbol, s.residual_z AS shifted FROM sized o JOIN (SELECT DISTINCT draw, block, \"offset\" FROM offsets WHERE symbol = 'A2') f USING (block) JOIN sized s ON s.block = o.block AND s.symbol = o.symbol AND s.slot = o.slot AND s.day = (o.day - f.\"offset\" + o.days) % o.days", "offsets", f="shifted")
def circular_shift_panel(spark, root):
    b = _blocked(spark, root)
    return synchronization.shifted(b, _offsets(b).where("symbol = 'A2'").drop("symbol"), "residual_z").select(F.col("draw").cast("long").alias("draw"), "bucket_start", "symbol", "shifted")


@query("SELECT bucket_start, major_flow FROM (SELECT *, row_number() OVER (ORDER BY bucket_start) AS r FROM flows) WHERE (r - 1) % 8 = 0", "flows", f="major_flow")
def stride_sample(spark, root):
    """Sampling is the operator: every eighth bucket of a plot's series."""
    return positions.numbered(_flows(spark, root), ["bucket_start"]).where("position % 8 = 0").select("bucket_start", "major_flow")


# --- regressions and tests ---------------------------------------------------------------------------------------------


@query("SELECT bucket_start, symbol, fitted, residual, residual_z FROM z", "z", f="fitted residual residual_z")
def residualize_k2(spark, root):
    return _residuals(spark, root).select("bucket_start", "symbol", "fitted", "residual", "residual_z")


@query()
def residualize_full(spark, root):
    """The fifteen-term design; tests hold it against a dense solve."""
    x = _features(spark, root)
    return regression.residualized(x, "aggressor_imbalance", panel.design(x))[0].select("bucket_start", "symbol", "fitted", "residual", "residual_z")


@query("SELECT symbol, b1 AS beta1, b2 AS beta2, b0 AS alpha FROM fit", "fit", f="beta1 beta2 alpha")
def ols2_closed_form(spark, root):
    x = _features(spark, root).where("sample_split = 'development'")
    return x.groupBy("symbol").agg(*regression.moments(F.col("own_return"), F.col("loo_market_return"), F.col("aggressor_imbalance"))).select("symbol", *(v.alias(k) for k, v in regression.slopes().items()))


_BETA = "(covar_pop(x1, y) * var_pop(x2) - covar_pop(x2, y) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ** 2)"


@query(f"SELECT direction, count(*) AS n, {_BETA} AS beta FROM both_designs GROUP BY 1", "both_designs", f="beta")
def lead_lag_betas(spark, root):
    d = _both(spark, root).groupBy("direction").agg(*regression.moments(F.col("x1"), F.col("x2"), F.col("y")))
    return d.withColumns(regression.slopes()).select("direction", F.col("n").cast("long").alias("n"), F.col("beta1").alias("beta"))


@query(
    f"SELECT half, {_BETA} AS beta FROM (SELECT *, CASE WHEN 2 * epoch_us(bucket_start) <= (SELECT min(epoch_us(bucket_start)) + max(epoch_us(bucket_start)) FROM design) THEN 1 ELSE 2 END AS half FROM design) GROUP BY 1",
    "design",
    f="beta",
)
def half_betas(spark, root):
    return regression.half_betas(_design(spark, root))


_HAC = """SELECT n, b1 AS beta, sqrt(v) AS se, b1 / sqrt(v) AS t FROM (
  SELECT n, b1, sum(w * i0 * j0) AS v FROM (
    SELECT f.n, f.b1, CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / 5.0) END AS w, p.e * (q.r0 + q.r1 * p.x1 + q.r2 * p.x2) AS i0, o.e * (q.r0 + q.r1 * o.x1 + q.r2 * o.x2) AS j0
    FROM f, q, e p, e o, range(5) t(l) WHERE o.r = p.r - l) GROUP BY 1, 2)"""


@query(
    f"""WITH f AS (SELECT count(*) AS n, {_BETA} AS b1, (covar_pop(x2, y) * var_pop(x1) - covar_pop(x1, y) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ** 2) AS b2, avg(y) - b1 * avg(x1) - b2 * avg(x2) AS b0,
  avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12 FROM design),
  q AS (SELECT s22 / (s11 * s22 - s12 ** 2) AS r1, -s12 / (s11 * s22 - s12 ** 2) AS r2, -(r1 * m1 + r2 * m2) AS r0 FROM f),
  e AS (SELECT x1, x2, y - b0 - b1 * x1 - b2 * x2 AS e, row_number() OVER (ORDER BY bucket_start) AS r FROM design, f) {_HAC}""",
    "design",
    f="beta se t",
)
def hac_ols(spark, root):
    return regression.hac(_design(spark, root), "y", "x1", "x2", "bucket_start", 4)


@query(
    f"""WITH h AS (SELECT *, CASE WHEN 2 * epoch_us(bucket_start) <= (SELECT min(epoch_us(bucket_start)) + max(epoch_us(bucket_start)) FROM design) THEN 1 ELSE 2 END AS half FROM design),
  f AS (SELECT half, count(*) AS n, {_BETA} AS b1, (covar_pop(x2, y) * var_pop(x1) - covar_pop(x1, y) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ** 2) AS b2, avg(y) - b1 * avg(x1) - b2 * avg(x2) AS b0,
  avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12 FROM h GROUP BY half),
  q AS (SELECT half, s22 / (s11 * s22 - s12 ** 2) AS r1, -s12 / (s11 * s22 - s12 ** 2) AS r2, -(r1 * m1 + r2 * m2) AS r0 FROM f),
  e AS (SELECT half, (y - b0 - b1 * x1 - b2 * x2) * (r0 + r1 * x1 + r2 * x2) AS u, row_number() OVER (PARTITION BY half ORDER BY bucket_start) AS r FROM h JOIN f USING (half) JOIN q USING (half)),
  v AS (SELECT p.half, sum(CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / 5.0) END * p.u * o.u) AS v FROM e p, e o, range(5) t(l) WHERE o.half = p.half AND o.r = p.r - l GROUP BY 1)
  SELECT half, n, b1 AS beta, sqrt(v) AS se, b1 / sqrt(v) AS t FROM f JOIN v USING (half)""",
    "design",
    f="beta se t",
)
def half_hac(spark, root):
    return regression.half_fits(_design(spark, root), 4)


_DRAWN = "SELECT d AS draw, (d * 13 + k * 7 + k * k * d) % n AS day_index, count(*) AS times FROM range(1, 21) t(d), range(15) u(k), (SELECT 15 AS n) GROUP BY 1, 2"


def _drawn(spark, days=15, draws=20):
    one = spark.range(1, draws + 1).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k"))
    return one.groupBy("draw", ((F.col("draw") * 13 + F.col("k") * 7 + F.col("k") * F.col("k") * F.col("draw")) % days).alias("day_index")).agg(F.count("*").alias("times"))


@query(
    f"SELECT draw, {_BETA} AS beta FROM (SELECT g.draw, y, x1, x2 FROM (SELECT *, dense_rank() OVER (ORDER BY bucket_start::DATE) - 1 AS i FROM design) x JOIN ({_DRAWN}) g ON g.day_index = x.i, range(g.times) WHERE true) GROUP BY 1",
    "design",
    f="beta",
)
def day_bootstrap(spark, root):
    return regression.day_bootstrap(_design(spark, root), _drawn(spark))


@query("SELECT draw, mean_pairwise_correlation FROM null_corr", "null_corr", f="mean_pairwise_correlation")
def sync_null_fixed(spark, root):
    b = _blocked(spark, root)
    return synchronization.shifted_correlations(b, _offsets(b), "residual_z").withColumn("draw", F.col("draw").cast("long"))


@query("SELECT draw, alignment_rate FROM null_align", "null_align", f="alignment_rate")
def alignment_null_fixed(spark, root):
    b = _blocked(spark, root)
    return synchronization.alignment(synchronization.shifted(b, _offsets(b), "residual_z"), "shifted", 6, "draw").select(F.col("draw").cast("long").alias("draw"), "alignment_rate")


_SUMMARY = "max(o) AS observed, avg(v) AS null_mean, stddev_samp(v) AS null_std, quantile_cont(v, 0.95) AS null_p95, quantile_cont(v, 0.99) AS null_p99, (1 + count(*) FILTER (v >= o)) / (count(*) + 1.0::DOUBLE) AS p_value, max(o) - avg(v) AS excess, max(o) / avg(v) AS ratio"


@query(f"SELECT {_SUMMARY} FROM (SELECT mean_pairwise_correlation AS v, (SELECT avg(correlation) FROM pairs) AS o FROM null_corr)", "null_corr", "pairs", f="observed null_mean null_std null_p95 null_p99 p_value excess ratio")
def null_summary(spark, root):
    b = _blocked(spark, root)
    seen = synchronization.pairwise_corr(b, "residual_z").agg(F.avg("correlation").alias("observed"))
    return synchronization.null_summary(synchronization.shifted_correlations(b, _offsets(b), "residual_z"), "mean_pairwise_correlation", seen)


_MOVED_VENUE = """SELECT f.draw, o.bucket_start, o.symbol, o.flow AS l, s.flow AS r FROM v o JOIN range(1, 21) f(draw) ON true
  JOIN v s ON s.venue = 'second' AND s.symbol = o.symbol AND s.slot = o.slot AND s.day = (o.day - (3 + f.draw * 7 % 10) + 15) % 15 WHERE o.venue = 'first'"""


@query(
    f"WITH v AS (SELECT *, hour(bucket_start) // 6 AS slot, datediff('day', DATE '2024-01-16', bucket_start::DATE) AS day FROM venues WHERE sample_split = 'oos'), m AS ({_MOVED_VENUE}) SELECT draw, avg(c) AS mean_same_asset_correlation FROM (SELECT draw, symbol, corr(l, r) AS c FROM m GROUP BY 1, 2) GROUP BY 1",
    "venues",
    f="mean_same_asset_correlation",
)
def cross_null_fixed(spark, root):
    """The second venue's panel is moved as a whole."""
    v = synchronization.blocks(_venues(spark, root).where("sample_split = 'oos'"), SLOTS, "month")
    draws = v.select("block").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("offset", (3 + F.col("draw") * 7 % 10).cast("int"))
    moved = synchronization.shifted(v.where("venue = 'second'"), draws, "flow")
    both = v.where("venue = 'first'").select("bucket_start", "symbol", "flow").join(moved, ["bucket_start", "symbol"])
    return both.groupBy("draw", "symbol").agg(F.corr("flow", "shifted").alias("c")).groupBy(F.col("draw").cast("long").alias("draw")).agg(F.avg("c").alias("mean_same_asset_correlation"))


@query(
    f"""WITH v AS (SELECT *, hour(bucket_start) // 6 AS slot, datediff('day', DATE '2024-01-16', bucket_start::DATE) AS day FROM venues WHERE sample_split = 'oos'), m AS ({_MOVED_VENUE}),
  n AS (SELECT draw, avg(c) AS v FROM (SELECT draw, symbol, corr(l, r) AS c FROM m GROUP BY 1, 2) GROUP BY 1), o AS (SELECT avg(c) AS o FROM (SELECT symbol, corr(a.flow, b.flow) AS c FROM v a JOIN v b USING (bucket_start, symbol) WHERE a.venue = 'first' AND b.venue = 'second' GROUP BY 1))
  SELECT {_SUMMARY} FROM n, o""",
    "venues",
    f="observed null_mean null_std null_p95 null_p99 p_value excess ratio",
)
def cross_null_summary(spark, root):
    seen = _EXACT["same_asset_corr"](spark, root).select(F.col("mean_same_asset_correlation").alias("observed"))
    return synchronization.null_summary(_EXACT["cross_null_fixed"](spark, root), "mean_same_asset_correlation", seen)


@query(
    f"""WITH v AS (SELECT *, hour(bucket_start) // 6 AS slot, datediff('day', DATE '2024-01-16', bucket_start::DATE) AS day FROM venues WHERE sample_split = 'oos'),
  m AS (SELECT draw, bucket_start, avg(r) AS m FROM ({_MOVED_VENUE}) GROUP BY 1, 2),
  own AS (SELECT regr_slope(second_flow, m) AS b, regr_intercept(second_flow, m) AS a FROM (SELECT bucket_start, avg(flow) AS m FROM v WHERE venue = 'second' GROUP BY 1) JOIN common USING (bucket_start))
  SELECT draw::BIGINT AS draw, avg((sign(first_flow) = sign(a + b * m))::INT) AS concordance, count(*) AS event_count FROM m JOIN common USING (bucket_start), own, {_EDGES} WHERE abs(first_flow) > e1 OR abs(a + b * m) > e2 + 1e-12 GROUP BY 1""",
    "venues",
    "common",
    f="concordance",
)
def cross_null_concordance(spark, root):
    """Concordance of extreme common flows where the second venue is moved as a whole and brought back to its own scale."""
    v = synchronization.blocks(_venues(spark, root).where("sample_split = 'oos'"), SLOTS, "month")
    draws = v.select("block").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("offset", (3 + F.col("draw") * 7 % 10).cast("int"))
    second = v.where("venue = 'second'")
    found = synchronization.concordance_null(synchronization.shifted(second, draws, "flow"), second, _edged(spark, root), "flow", "first_flow", "second_flow", F.col("e1"), F.col("e2"))
    return found.withColumn("draw", F.col("draw").cast("long"))


def _cross_design(spark, root, source, target):
    return regression.lead_design(_common(spark, root).where("sample_split = 'oos'"), source, target, 1, True)


_CROSS = """SELECT * FROM (SELECT bucket_start, {t} AS x2, {s} AS x1, lead({t}) OVER (ORDER BY bucket_start) AS y, lead(bucket_start) OVER (ORDER BY bucket_start) AS t FROM common WHERE sample_split = 'oos') WHERE y IS NOT NULL AND bucket_start::DATE = t::DATE AND {where}"""


@query(
    f"""WITH one AS ({_CROSS.format(s="first_flow", t="second_flow", where="day(bucket_start) <> 20")}), two AS ({_CROSS.format(s="second_flow", t="first_flow", where="day(bucket_start) <> 23")}),
  days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT bucket_start::DATE AS d FROM one INTERSECT SELECT bucket_start::DATE FROM two)), g AS ({_DRAWN.replace("15", "13")}),
  a AS (SELECT draw, {_BETA} AS a FROM (SELECT g.draw, y, x1, x2 FROM one JOIN days ON days.d = one.bucket_start::DATE JOIN g ON g.day_index = days.i, range(g.times)) GROUP BY 1),
  b AS (SELECT draw, {_BETA} AS b FROM (SELECT g.draw, y, x1, x2 FROM two JOIN days ON days.d = two.bucket_start::DATE JOIN g ON g.day_index = days.i, range(g.times)) GROUP BY 1)
  SELECT draw, a AS beta_first_to_second, b AS beta_second_to_first, a - b AS difference FROM a JOIN b USING (draw)""",
    "common",
    f="beta_first_to_second beta_second_to_first difference",
)
def cross_bootstrap(spark, root):
    """Both directions between venues over the same resampled days; each side lacks one day here, so that 13 are shared."""
    one = _cross_design(spark, root, "first_flow", "second_flow").where(F.dayofmonth("bucket_start") != 20)
    two = _cross_design(spark, root, "second_flow", "first_flow").where(F.dayofmonth("bucket_start") != 23)
    days, drawn = regression.shared_days(one, two), _drawn(spark, 13)
    a, b = (regression.day_bootstrap(x, drawn, days=days).withColumnRenamed("beta", n) for x, n in ((one, "beta_first_to_second"), (two, "beta_second_to_first")))
    return a.join(b, "draw").withColumn("difference", F.col("beta_first_to_second") - F.col("beta_second_to_first"))


# --- futures -----------------------------------------------------------------------------------------------------------


@query("SELECT bucket_start, symbol, taker_direction, open_interest, source_rows FROM futures", "futures", f="taker_direction open_interest")
def futures_mean(spark, root):
    return _futures(spark, root)


@query("SELECT bucket_start, symbol, taker_last AS taker_direction, open_interest, source_rows FROM futures", "futures", f="taker_direction open_interest")
def futures_last(spark, root):
    return _futures(spark, root, "last")


_JOINED = """WITH five AS (SELECT * FROM futures WHERE symbol IN ('A0', 'A1', 'A2', 'A3', 'A4') AND bucket_start IN (SELECT bucket_start FROM futures WHERE symbol IN ('A0', 'A1', 'A2', 'A3', 'A4') GROUP BY 1 HAVING count(*) = 5)),
  sc AS (SELECT symbol, avg(taker_direction) AS c, stddev_samp(taker_direction) AS s FROM five WHERE bucket_start < TIMESTAMP '2024-01-16' GROUP BY 1),
  m AS (SELECT bucket_start, avg((taker_direction - c) / s) AS m FROM five JOIN sc USING (symbol) GROUP BY 1),
  j AS (SELECT f.bucket_start, f.sample_split, five_flow, (m - (SELECT avg(m) FROM m WHERE bucket_start < TIMESTAMP '2024-01-16')) / (SELECT stddev_samp(m) FROM m WHERE bucket_start < TIMESTAMP '2024-01-16') AS futures_flow FROM flows f JOIN m USING (bucket_start)),
  d AS (SELECT bucket_start, futures_flow AS y, five_flow AS x1, lag(futures_flow) OVER (ORDER BY bucket_start) AS x2, abs(five_flow) >= (SELECT quantile_cont(abs(five_flow), 0.9) FROM j WHERE sample_split = 'development') AS event FROM j WHERE sample_split = 'oos')"""


@query(
    f"{_JOINED} SELECT (SELECT count(*) FROM d WHERE x2 IS NOT NULL) AS observations, (SELECT {_BETA} FROM d WHERE x2 IS NOT NULL) AS beta, count(*) FILTER (event) AS event_count, count(*) FILTER (event AND sign(y) = sign(x1)) AS matches FROM d",
    "futures",
    "flows",
    f="beta",
)
def futures_confirmation(spark, root):
    from . import studies

    d = studies.futures_joined(_futures(spark, root), _flows(spark, root), FIVE, SPLIT)
    return studies.futures_figures(d, 0.9)


# --- order books -------------------------------------------------------------------------------------------------------


@query("SELECT symbol, ts, event_id, side, price, size FROM msgs", "msgs")
def book_levels(spark, root):
    """Through the nested form: each message's one level goes into its side's array and out again."""
    m = _messages(spark, root)
    level = F.array(F.array(F.col("price").cast("string"), F.col("size").cast("string"), F.lit("1")))
    none = F.array().cast("array<array<string>>")
    nested = m.select("symbol", "seq", "ts", F.when(F.col("side") == "ask", level).otherwise(none).alias("asks"), F.when(F.col("side") == "bid", level).otherwise(none).alias("bids"))
    return book.levels(nested).select("symbol", "ts", F.col("seq.event_id").alias("event_id"), "side", "price", "size")


@query("SELECT symbol, ts, event_id, epoch FROM epochs", "epochs")
def book_epoch(spark, root):
    return book.epochs(_messages(spark, root), F.to_date("ts")).select("symbol", "ts", F.col("seq.event_id").alias("event_id"), "epoch")


@query("SELECT symbol, sample_ts, at_id AS event_id FROM sampled", "sampled")
def minute_sampler(spark, root):
    return _sampled(spark, root)[1].select("symbol", F.col("ts").alias("sample_ts"), F.col("seq.event_id").alias("event_id"))


@query("SELECT symbol, sample_ts, side, price, size FROM book", "book")
def book_asof(spark, root):
    e, s = _sampled(spark, root)
    return book.as_of(e, s)


@query("SELECT symbol, sample_ts, side, price, size FROM book", "book")
def book_in_parts(spark, root):
    """The same books, each day by itself from the levels that it opens with."""
    e, s = _sampled(spark, root)
    return book.as_of(e, s, part=F.to_date("ts"))


_TOP = "spread_bps " + " ".join(f"ask_depth_{k} bid_depth_{k} depth_{k} imbalance_{k}" for k in (1, 5, 10))


@query(f"SELECT symbol, sample_ts, empty, crossed, best_bid, best_ask, CASE WHEN ask_levels + bid_levels > 0 THEN ask_levels END AS ask_levels, CASE WHEN ask_levels + bid_levels > 0 THEN bid_levels END AS bid_levels, {', '.join(_TOP.split())} FROM minutes", "minutes", f=_TOP)
def book_topk(spark, root):
    return _minutes(spark, root)


@query("SELECT symbol, sample_ts, spread_bps FROM minutes WHERE NOT empty AND NOT crossed", "minutes", f="spread_bps")
def valid_books(spark, root):
    return _minutes(spark, root).where(~F.col("empty") & ~F.col("crossed")).select("symbol", "sample_ts", "spread_bps")


_LIQ = "spread_bps top10_depth_quote book_imbalance_10 abs_book_imbalance_10"


@query(f"SELECT bucket_start, symbol, observed_minutes, {', '.join(_LIQ.split())} FROM liquid", "liquid", f=_LIQ)
def book_features(spark, root):
    return book.liquidity(_minutes(spark, root), "1 day")


@query(
    """SELECT symbol, count(*) AS rows, count(*) FILTER (action = 'snapshot') AS snapshots, count(*) FILTER (action = 'update') AS updates, 0::BIGINT AS unknown_actions, count(*) FILTER (gap < 0) AS out_of_order_rows, count(*) FILTER (gap = 0) AS duplicate_timestamps,
  count(*) FILTER (size = 0) AS zero_size_deletions, count(*) FILTER (gap > 100) AS gaps_over_100ms, count(*) FILTER (gap > 1000) AS gaps_over_1s, count(*) FILTER (gap > 5000) AS gaps_over_5s, coalesce(max(gap) FILTER (gap > 0), 0) AS max_gap_ms, min(ts) AS first_timestamp, max(ts) AS last_timestamp
  FROM (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS gap FROM msgs) GROUP BY 1""",
    "msgs",
)
def stream_audit(spark, root):
    return book.audit(_messages(spark, root), F.to_date("ts"))


@query(
    f"""SELECT 'synchronization' AS family, symbol AS metric, b AS old_estimate, a AS new_estimate, a / b AS ratio FROM (SELECT symbol, stddev_samp(flow) FILTER (venue = 'first') AS b, stddev_samp(flow) FILTER (venue = 'second') AS a FROM venues GROUP BY 1)
  UNION ALL SELECT 'lead_lag', direction, b, a, NULL FROM (SELECT direction, {_BETA} AS b FROM both_designs GROUP BY 1) JOIN (SELECT direction, {_BETA} AS a FROM both_designs WHERE bucket_start >= TIMESTAMP '2024-01-20' GROUP BY 1) USING (direction)""",
    "venues",
    "both_designs",
    f="old_estimate new_estimate ratio",
)
def provider_comparison(spark, root):
    """Second venue against first, and the betas of the later days against those of all."""
    from . import studies

    v = _venues(spark, root)
    side = lambda name: v.where(F.col("venue") == name).groupBy(F.col("symbol").alias("metric")).agg(F.stddev_samp("flow").alias("observed"))
    betas = lambda d: d.groupBy(F.col("direction").alias("metric")).agg(*regression.moments(F.col("x1"), F.col("x2"), F.col("y"))).withColumns(regression.slopes()).withColumnRenamed("beta1", "standardized_beta")
    both = _both(spark, root)
    return studies.provider_comparison(side("second"), betas(both.where(F.col("bucket_start") >= F.lit("2024-01-20").cast("timestamp_ntz"))), side("first"), betas(both))
