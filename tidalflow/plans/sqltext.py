"""Named pieces of DuckDB SQL, from which the catalogue's twins are put together."""

from __future__ import annotations

#: name -> (pieces it needs, text)
PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": ((), "SELECT 'A' || (user_id % 7) AS symbol, event_id AS trade_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 1 + CAST(props->>'$.k' AS DOUBLE) AS price, value AS size, ts FROM events"),
    "buckets": (
        ("trades",),
        """SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket_start, symbol, min(ts) AS first_timestamp, max(ts) AS last_timestamp,
  first(price ORDER BY ts, trade_id) AS first_price, last(price ORDER BY ts, trade_id) AS last_price, count(*) AS transaction_count, sum(size) AS total_quantity,
  sum(price * size) AS total_quote_quantity, sum(CASE WHEN side = 'buy' THEN price * size ELSE 0 END) AS buy_quote_quantity,
  sum(CASE WHEN side = 'sell' THEN price * size ELSE 0 END) AS sell_quote_quantity, last_price / nullif(first_price, 0) - 1 AS bucket_return,
  (buy_quote_quantity - sell_quote_quantity) / nullif(total_quote_quantity, 0) AS aggressor_imbalance FROM trades GROUP BY 1, 2""",
    ),
    "features": (
        ("buckets",),
        """SELECT *, bucket_return AS own_return, (sum(bucket_return) OVER b - bucket_return) / 6 AS loo_market_return, abs(bucket_return) AS abs_own_return,
  abs((sum(bucket_return) OVER b - bucket_return) / 6) AS abs_loo_market_return, ln(1 + greatest(total_quote_quantity, 0)) AS log_quote_volume, ln(1 + greatest(transaction_count, 0)) AS log_transaction_count,
  sin(2 * pi() * (hour(bucket_start) + minute(bucket_start) / 60.0) / 24) AS hour_sin, cos(2 * pi() * (hour(bucket_start) + minute(bucket_start) / 60.0) / 24) AS hour_cos,
  isodow(bucket_start) - 1 AS weekday, CASE WHEN bucket_start >= TIMESTAMP '2024-01-01' AND bucket_start < TIMESTAMP '2024-01-16' THEN 'development'
  WHEN bucket_start >= TIMESTAMP '2024-01-16' AND bucket_start < TIMESTAMP '2024-01-31' THEN 'oos' ELSE 'excluded' END AS sample_split
  FROM buckets WINDOW b AS (PARTITION BY bucket_start)""",
    ),
    "fit": (
        ("features",),
        """SELECT symbol, var_pop(own_return) AS v11, var_pop(loo_market_return) AS v22, covar_pop(own_return, loo_market_return) AS v12, covar_pop(own_return, aggressor_imbalance) AS v1y,
  covar_pop(loo_market_return, aggressor_imbalance) AS v2y, (v1y * v22 - v2y * v12) / (v11 * v22 - v12 * v12) AS b1, (v2y * v11 - v1y * v12) / (v11 * v22 - v12 * v12) AS b2,
  avg(aggressor_imbalance) - b1 * avg(own_return) - b2 * avg(loo_market_return) AS b0 FROM features WHERE sample_split = 'development' GROUP BY symbol""",
    ),
    "residuals": (("features", "fit"), "SELECT f.*, b0 + b1 * own_return + b2 * loo_market_return AS fitted, aggressor_imbalance - (b0 + b1 * own_return + b2 * loo_market_return) AS residual FROM features f JOIN fit USING (symbol)"),
    "z": (
        ("residuals",),
        """SELECT r.bucket_start, r.symbol, r.sample_split, r.fitted, r.residual, (r.residual - c) / s AS residual_z FROM residuals r
  JOIN (SELECT symbol, avg(residual) AS c, stddev_samp(residual) AS s FROM residuals WHERE sample_split = 'development' GROUP BY 1) USING (symbol)""",
    ),
    "oos": (("z",), "SELECT bucket_start, symbol, residual_z FROM z WHERE sample_split = 'oos'"),
    "pairs": (("oos",), "SELECT a.symbol AS left_symbol, b.symbol AS right_symbol, corr(a.residual_z, b.residual_z) AS correlation FROM oos a JOIN oos b ON a.bucket_start = b.bucket_start AND a.symbol < b.symbol GROUP BY 1, 2"),
    "raw_flows": (
        ("z",),
        """SELECT bucket_start, any_value(sample_split) AS sample_split, avg(residual_z) FILTER (symbol IN ('A0', 'A1')) AS major, avg(residual_z) FILTER (symbol NOT IN ('A0', 'A1')) AS alt,
  avg(residual_z) FILTER (symbol IN ('A0', 'A1', 'A2', 'A3', 'A4')) AS five FROM z GROUP BY 1""",
    ),
    "flows": (
        ("raw_flows",),
        """SELECT bucket_start, sample_split, (major - (SELECT avg(major) FROM raw_flows WHERE sample_split = 'development')) / (SELECT stddev_samp(major) FROM raw_flows WHERE sample_split = 'development') AS major_flow,
  (alt - (SELECT avg(alt) FROM raw_flows WHERE sample_split = 'development')) / (SELECT stddev_samp(alt) FROM raw_flows WHERE sample_split = 'development') AS alt_flow,
  (five - (SELECT avg(five) FROM raw_flows WHERE sample_split = 'development')) / (SELECT stddev_samp(five) FROM raw_flows WHERE sample_split = 'development') AS five_flow FROM raw_flows""",
    ),
    "oos_flows": (("flows",), "SELECT * FROM flows WHERE sample_split = 'oos'"),
    "design": (
        ("oos_flows",),
        "SELECT * FROM (SELECT bucket_start, lead(alt_flow, 1) OVER (ORDER BY bucket_start) AS y, lead(bucket_start, 1) OVER (ORDER BY bucket_start) AS nxt, major_flow AS x1, alt_flow AS x2 FROM oos_flows) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL",
    ),
    "back_design": (
        ("oos_flows",),
        "SELECT * FROM (SELECT bucket_start, lead(major_flow, 1) OVER (ORDER BY bucket_start) AS y, lead(bucket_start, 1) OVER (ORDER BY bucket_start) AS nxt, alt_flow AS x1, major_flow AS x2 FROM oos_flows) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL",
    ),
    "both_designs": (("design", "back_design"), "SELECT 'major_to_alt' AS direction, * FROM design UNION ALL SELECT 'alt_to_major', * FROM back_design"),
    "blocks": (
        ("oos",),
        """SELECT *, (year(bucket_start) * 12 + month(bucket_start) - 1) * 2 + CASE WHEN day(bucket_start) > 15 THEN 1 ELSE 0 END AS block, hour(bucket_start) // 6 AS slot,
  dense_rank() OVER (PARTITION BY (year(bucket_start) * 12 + month(bucket_start) - 1) * 2 + CASE WHEN day(bucket_start) > 15 THEN 1 ELSE 0 END ORDER BY bucket_start::DATE) - 1 AS day FROM oos""",
    ),
    "sized": (("blocks",), "SELECT *, max(day) OVER (PARTITION BY block) + 1 AS days FROM blocks"),
    "offsets": (("sized",), "SELECT d AS draw, block, symbol, 3 + (d * 7 + CAST(substr(symbol, 2) AS BIGINT) * 3) % (days - 5) AS \"offset\" FROM (SELECT DISTINCT block, symbol, days FROM sized), range(1, 21) t(d)"),
    "moved": (
        ("sized", "offsets"),
        "SELECT draw, o.bucket_start, o.symbol, s.residual_z AS shifted FROM sized o JOIN offsets f USING (block, symbol) JOIN sized s ON s.block = o.block AND s.symbol = o.symbol AND s.slot = o.slot AND s.day = (o.day - f.\"offset\" + o.days) % o.days",
    ),
    "moved_pairs": (("moved",), "SELECT a.draw, a.symbol AS l, b.symbol AS r, corr(a.shifted, b.shifted) AS c FROM moved a JOIN moved b ON a.draw = b.draw AND a.bucket_start = b.bucket_start AND a.symbol < b.symbol GROUP BY 1, 2, 3"),
    "null_corr": (("moved_pairs",), "SELECT draw, avg(c) AS mean_pairwise_correlation FROM moved_pairs GROUP BY 1"),
    "moved_marks": (("moved",), "SELECT draw, bucket_start, greatest(count(*) FILTER (shifted > 0), count(*) FILTER (shifted < 0)) AS most FROM moved GROUP BY 1, 2"),
    "null_align": (("moved_marks",), "SELECT draw, avg((most >= 6)::INT) AS alignment_rate FROM moved_marks GROUP BY 1"),
    "metrics": ((), "SELECT 'A' || (user_id % 7) AS symbol, ts, event_id AS row_id, CASE WHEN event_type <> 'error' THEN value END AS open_interest, (1 + CAST(props->>'$.k' AS DOUBLE)) / 50 AS taker_ratio FROM events"),
    "futures": (
        ("metrics",),
        """SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket_start, symbol, avg((greatest(taker_ratio, 0) - 1) / (greatest(taker_ratio, 0) + 1)) AS taker_direction,
  last((greatest(taker_ratio, 0) - 1) / (greatest(taker_ratio, 0) + 1) ORDER BY ts, row_id) AS taker_last, last(open_interest ORDER BY ts, row_id) FILTER (open_interest IS NOT NULL) AS open_interest, count(*) AS source_rows FROM metrics GROUP BY 1, 2""",
    ),
    "oi": (("futures",), "SELECT *, ln(CASE WHEN open_interest > 0 THEN open_interest END) - lag(ln(CASE WHEN open_interest > 0 THEN open_interest END)) OVER (PARTITION BY symbol ORDER BY bucket_start) AS log_oi_change FROM futures"),
    "msgs": (
        (),
        """SELECT 'A' || (user_id % 7) AS symbol, ts, event_id, CASE WHEN event_type = 'signup' THEN 'snapshot' ELSE 'update' END AS action, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  CAST(props->>'$.k' AS DOUBLE) + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 101 END AS price, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS size FROM events""",
    ),
    "epochs": (("msgs",), "SELECT *, sum(CASE WHEN action = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM msgs"),
    "sampled": (
        ("epochs",),
        """SELECT symbol, ts AS sample_ts, event_id AS at_id, epoch FROM (SELECT *, epoch_us(ts) // 21600000000 AS k, max(epoch_us(ts) // 21600000000) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM epochs) WHERE b IS NULL OR k > b""",
    ),
    "book": (
        ("epochs", "sampled"),
        "SELECT * FROM (SELECT s.symbol, sample_ts, side, price, last(size ORDER BY ts, event_id) AS size FROM sampled s JOIN epochs u ON u.symbol = s.symbol AND u.epoch = s.epoch AND (u.ts, u.event_id) <= (s.sample_ts, s.at_id) GROUP BY 1, 2, 3, 4) WHERE size <> 0",
    ),
    "ranked": (("book",), "SELECT *, row_number() OVER (PARTITION BY symbol, sample_ts, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS k FROM book"),
    "tops": (
        ("ranked", "sampled"),
        """SELECT s.symbol, s.sample_ts, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, count(*) FILTER (side = 'ask') AS ask_levels, count(*) FILTER (side = 'bid') AS bid_levels,
  count(*) FILTER (side = 'ask') = 0 OR count(*) FILTER (side = 'bid') = 0 AS empty, sum(price * size) FILTER (side = 'ask' AND k <= 1) AS a1, sum(price * size) FILTER (side = 'bid' AND k <= 1) AS b1,
  sum(price * size) FILTER (side = 'ask' AND k <= 5) AS a5, sum(price * size) FILTER (side = 'bid' AND k <= 5) AS b5, sum(price * size) FILTER (side = 'ask' AND k <= 10) AS a10, sum(price * size) FILTER (side = 'bid' AND k <= 10) AS b10
  FROM sampled s LEFT JOIN ranked USING (symbol, sample_ts) GROUP BY 1, 2""",
    ),
    "minutes": (
        ("tops",),
        """SELECT symbol, sample_ts, empty, NOT empty AND best_bid >= best_ask AS crossed, best_bid, best_ask, ask_levels, bid_levels, CASE WHEN NOT empty THEN (best_ask - best_bid) / ((best_ask + best_bid) / 2) * 10000 END AS spread_bps,
  CASE WHEN NOT empty THEN a1 END AS ask_depth_1, CASE WHEN NOT empty THEN b1 END AS bid_depth_1, CASE WHEN NOT empty THEN a5 END AS ask_depth_5, CASE WHEN NOT empty THEN b5 END AS bid_depth_5, CASE WHEN NOT empty THEN a10 END AS ask_depth_10, CASE WHEN NOT empty THEN b10 END AS bid_depth_10,
  CASE WHEN NOT empty THEN a1 + b1 END AS depth_1, CASE WHEN NOT empty THEN (b1 - a1) / (a1 + b1) END AS imbalance_1, CASE WHEN NOT empty THEN a5 + b5 END AS depth_5, CASE WHEN NOT empty THEN (b5 - a5) / (a5 + b5) END AS imbalance_5,
  CASE WHEN NOT empty THEN a10 + b10 END AS depth_10, CASE WHEN NOT empty THEN (b10 - a10) / (a10 + b10) END AS imbalance_10 FROM tops""",
    ),
    "liquid": (
        ("minutes",),
        "SELECT time_bucket(INTERVAL '1 day', sample_ts) AS bucket_start, symbol, median(spread_bps) AS spread_bps, median(depth_10) AS top10_depth_quote, median(imbalance_10) AS book_imbalance_10, median(abs(imbalance_10)) AS abs_book_imbalance_10, count(*) AS observed_minutes FROM minutes WHERE NOT empty AND NOT crossed GROUP BY 1, 2",
    ),
    "venue_cells": (
        ("trades",),
        """SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket_start, symbol, CASE WHEN trade_id % 3 = 0 THEN 'second' ELSE 'first' END AS venue, sum(CASE WHEN side = 'buy' THEN price * size ELSE -price * size END) / sum(price * size) AS flow FROM trades GROUP BY 1, 2, 3""",
    ),
    "venues": (
        ("venue_cells",),
        """SELECT g.ts AS bucket_start, 'A' || a AS symbol, v AS venue, coalesce(flow, 0) AS flow, CASE WHEN g.ts < TIMESTAMP '2024-01-16' THEN 'development' ELSE 'oos' END AS sample_split
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 18:00:00', INTERVAL '6 hours') g(ts), range(7) t(a), (VALUES ('first'), ('second')) w(v)
  LEFT JOIN venue_cells c ON c.bucket_start = g.ts AND c.symbol = 'A' || a AND c.venue = v""",
    ),
    "venue_means": (("venues",), "SELECT bucket_start, venue, any_value(sample_split) AS sample_split, avg(flow) AS m FROM venues GROUP BY 1, 2"),
    "common": (
        ("venue_means",),
        """SELECT bucket_start, any_value(m.sample_split) AS sample_split, max((m - c) / s) FILTER (venue = 'first') AS first_flow, max((m - c) / s) FILTER (venue = 'second') AS second_flow FROM venue_means m
  JOIN (SELECT venue, avg(m) AS c, stddev_samp(m) AS s FROM venue_means WHERE sample_split = 'development' GROUP BY 1) USING (venue) GROUP BY 1""",
    ),
    "jobs": ((), "SELECT d::DATE AS date, 'A' || a AS symbol FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d), range(7) t(a)"),
    "progress": (
        (),
        "SELECT ts::DATE AS date, 'A' || (user_id % 7) AS symbol, CASE WHEN min(event_id) % 5 = 0 THEN 'unavailable' WHEN min(event_id) % 5 = 1 THEN 'failed' ELSE 'complete' END AS status, count(*) % 3 <> 0 AND min(event_id) % 5 > 1 AS quality_passed, max(ts) AS completed_at FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2",
    ),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the WITH clauses of the pieces that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in PIECES[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{PIECES[n][1]})" for n in order) + "\n" if order else "") + body
