"""Queries of the measurement and ingestion operators (problems 1, 2, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.grid import regular_grid
from panelmill.operators.parsing import invalid_rows, parse_klines, valid_bars
from panelmill.operators.rolling import rolling_totals
from panelmill.operators.spikes import flag_implausible
from panelmill.sources.tables import table


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(table(spark, d, "features"), "symbol", "timestamp", ["return_1", "log_quote_volume"], [7, 30], "row_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_implausible(table(spark, d, "bars")).select("bar_id", "field")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).where(~F.col("active")).select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("day", "yyyy-MM-dd").alias("day")

    def shown(v: str, p: int) -> list:
        # The mean is taken of the rounded total, so that the last digit does not hang on the order of summation.
        total, n = F.round(f"{v}_sum_{p}d", 9), F.col(f"{v}_count_{p}d")
        return [
            total.alias(f"{v}_sum_{p}d"), F.try_divide(total, n).alias(f"{v}_avg_{p}d"), n,
            F.round(f"{v}_min_{p}d", 9).alias(f"{v}_min_{p}d"), F.round(f"{v}_max_{p}d", 9).alias(f"{v}_max_{p}d"),
        ]

    return _rolling(spark, d).select("symbol", day, *[c for p in (7, 30) for v in ("return_1", "log_quote_volume") for c in shown(v, p)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rows(parse_klines(table(spark, d, "raw_klines"))).select("line_id", "reason")


def p4_bars(spark: SparkSession, d: str) -> DataFrame:
    return valid_bars(parse_klines(table(spark, d, "raw_klines")))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    contracts = table(spark, d, "contracts")
    return regular_grid(table(spark, d, "market_bars"), "symbol", "timestamp", "close", contracts, sequence="reading_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("missing").select("symbol", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    # Prices differ by orders of magnitude, so the estimate is shown to eight digits.
    estimate = F.format_string("%.7e", "estimate").cast("double")
    return _grid(spark, d).select(
        "symbol", "slot", "readings", "missing", F.when(F.col("estimate").isNotNull(), estimate).alias("estimate"), F.round("support", 6).alias("support"), "status"
    )


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_totals, p4_found, p4_bars, p5_found, p5_grid)}

_FEATURES_DAILY = """
  finite AS (
    SELECT row_id, symbol, "timestamp" AS ts,
           CASE WHEN isfinite(return_1) THEN return_1 END AS a,
           CASE WHEN isfinite(log_quote_volume) THEN log_quote_volume END AS b
    FROM features WHERE "timestamp" IS NOT NULL),
  once AS (
    SELECT symbol, ts, arg_max(a, row_id) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, row_id) FILTER (WHERE b IS NOT NULL) AS b
    FROM finite GROUP BY symbol, ts),
  usable AS (SELECT symbol, CAST(ts AS DATE) AS day, a, b FROM once WHERE a IS NOT NULL OR b IS NOT NULL),
  active AS (SELECT DISTINCT symbol, day FROM usable),
  days AS (
    SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM active GROUP BY symbol)
"""


def _trailing(v: str, name: str, p: int) -> str:
    w = f"u.day > d.day - {p}"
    return f"""
      coalesce(round(sum(u.{v}) FILTER (WHERE {w}), 9), 0.0) AS {name}_sum_{p}d, round(sum(u.{v}) FILTER (WHERE {w}), 9) / nullif(count(u.{v}) FILTER (WHERE {w}), 0) AS {name}_avg_{p}d,
      count(u.{v}) FILTER (WHERE {w}) AS {name}_count_{p}d, round(min(u.{v}) FILTER (WHERE {w}), 9) AS {name}_min_{p}d,
      round(max(u.{v}) FILTER (WHERE {w}), 9) AS {name}_max_{p}d"""


_NUM = "'([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"
#: The line's fields by regular expression (the engine there does not backtrack), as a check on the split at quotes.
_KLINES = f"""
  bare AS (SELECT line_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE coalesce(raw_line, '') END AS l FROM raw_klines),
  split AS (
    SELECT line_id, regexp_full_match(l, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS quoted_well,
           list_transform(regexp_extract_all(',' || l, ',("([^"]|"")*"|[^",]*)', 1),
             lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ' || chr(9))) AS f, l
    FROM bare),
  data AS (SELECT * FROM split WHERE lower(trim(replace(split_part(l, ',', 1), chr(65279), ''), ' "' || chr(9))) <> 'open_time'),
  judged AS (
    SELECT line_id, f, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> 12 THEN 'column_count'
      WHEN NOT (regexp_full_match(f[1], '[0-9]{{13}}|[0-9]{{16}}') AND regexp_full_match(f[7], '[0-9]{{13}}|[0-9]{{16}}') AND length(f[1]) = length(f[7])
           AND TRY_CAST(f[7] AS BIGINT) >= TRY_CAST(f[1] AS BIGINT) AND regexp_full_match(f[9], '[0-9]+') AND regexp_full_match(f[12], '(0+\\.?0*|\\.0+)([eE][+-]?[0-9]+)?') AND {' AND '.join(f"regexp_full_match(f[{i}], {_NUM}) AND coalesce(isfinite(TRY_CAST(f[{i}] AS DOUBLE)), false)" for i in (2, 3, 4, 5, 6, 8, 10, 11))})
      THEN 'value' END AS reason FROM data)
"""
_READINGS = """
  usable AS (
    SELECT m.symbol, floor(epoch_us(m."timestamp") / (60000000 * coalesce(c.n, 5)))::BIGINT AS slot, coalesce(c.n, 5) AS n
    FROM market_bars m LEFT JOIN (SELECT symbol, min(interval_minutes) FILTER (WHERE interval_minutes >= 1) AS n FROM contracts GROUP BY symbol) c USING (symbol)
    WHERE isfinite(m.close) AND m.close > 0 AND m."timestamp" IS NOT NULL),
  slots AS (SELECT symbol, n, unnest(generate_series(min(slot), max(slot))) AS slot FROM usable GROUP BY symbol, n)
"""

ORACLE = {
    "p2_found": f"WITH {_FEATURES_DAILY} SELECT symbol, strftime(day, '%Y-%m-%d') AS day FROM days ANTI JOIN active USING (symbol, day)",
    "p2_totals": f"""WITH {_FEATURES_DAILY} SELECT d.symbol, strftime(d.day, '%Y-%m-%d') AS day,
      {','.join(_trailing(v, n, p) for p in (7, 30) for v, n in (("a", "return_1"), ("b", "log_quote_volume")))}
      FROM days d LEFT JOIN usable u ON u.symbol = d.symbol AND u.day <= d.day AND u.day > d.day - 30 GROUP BY d.symbol, d.day""",
    "p4_found": f"WITH {_KLINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_bars": f"""WITH {_KLINES}, good AS (SELECT line_id, f, CASE WHEN length(f[1]) = 13 THEN 1000 ELSE 1 END AS k FROM judged WHERE reason IS NULL)
      SELECT line_id, make_timestamp(f[1]::BIGINT * k) AS "timestamp", make_timestamp(f[7]::BIGINT * k) AS available_time,
      {', '.join(f"f[{i}]::DOUBLE AS {c}" for i, c in ((2, "open"), (3, "high"), (4, "low"), (5, "close"), (6, "volume"), (8, "quote_volume"), (10, "taker_buy_volume"), (11, "taker_buy_quote_volume")))},
      TRY_CAST(f[9] AS BIGINT) AS trade_count, CASE WHEN TRY_CAST(f[9] AS BIGINT) IS NULL THEN f[9] END AS trade_count_overflow FROM good""",
    "p5_found": f"""WITH {_READINGS} SELECT symbol, strftime(make_timestamp(slot * n * 60000000), '%Y-%m-%d %H:%M') AS slot
      FROM slots ANTI JOIN usable USING (symbol, slot)""",
    "p5_grid": f"""WITH {_READINGS}, once AS (
        SELECT m.symbol, epoch_us(m."timestamp") AS moment, arg_max(m.close, m.reading_id) AS y FROM market_bars m
        WHERE isfinite(m.close) AND m.close > 0 AND m."timestamp" IS NOT NULL GROUP BY 1, 2),
      stepped AS (SELECT o.*, s.step FROM once o JOIN (SELECT DISTINCT symbol, n * 60000000 AS step FROM slots) s USING (symbol)),
      near AS (SELECT symbol, step, moment, y, unnest(generate_series(moment // step - 4, moment // step + 4)) AS slot FROM stepped),
      weighed AS (SELECT symbol, slot, y, u, 0.75 * (1 - u * u) AS w FROM (SELECT *, (moment - slot * step) / (3.0 * step) AS u FROM near) WHERE abs(u) < 1),
      sums AS (SELECT symbol, slot, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * w) AS q FROM weighed GROUP BY 1, 2),
      fitted AS (SELECT symbol, slot, s0 * s0 / q AS support, CASE WHEN s0 * s2 - s1 * s1 <= 1e-12 * s0 * s0 THEN t0 / s0 ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END AS estimate FROM sums),
      held AS (SELECT symbol, moment // step AS slot, count(*) AS readings FROM stepped GROUP BY 1, 2)
      SELECT symbol, make_timestamp(slot * n * 60000000) AS slot, coalesce(readings, 0) AS readings, readings IS NULL AS missing,
        CASE WHEN support >= 1.5 THEN printf('%.7e', estimate)::DOUBLE END AS estimate, round(coalesce(support, 0), 6) AS support,
        CASE WHEN readings IS NOT NULL THEN 'observed' WHEN support >= 1.5 THEN 'filled' ELSE 'missing' END AS status
      FROM slots LEFT JOIN fitted USING (symbol, slot) LEFT JOIN held USING (symbol, slot)""",
}
