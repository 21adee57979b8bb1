"""DuckDB building blocks for the comparison SQL: the derived tables, spelled out independently."""

from catalog.rounding import shift

PI_HALF = "(pi() / 2)"


def six(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


def rnd(x: str, digits: int = 8) -> str:
    return f"round({x} + {shift(digits)!r}, {digits}) + 0.0"


def final(source: str, exact: str = "session_date", digits: int = 8, **special: int) -> str:
    """Select everything, floats rounded; ``exact`` lists the columns left as they are."""
    names = [c.strip() for c in exact.split(",") if c.strip()]
    skip = names + list(special)
    head = ", ".join(names + [f"{rnd(c, d)} AS {c}" for c, d in special.items()])
    excl = f" EXCLUDE ({', '.join(skip)})" if skip else ""
    return f"SELECT {head}{', ' if head else ''}{rnd(f'COLUMNS(*{excl})', digits)} FROM {source}"


def bars(keys: bool = False) -> str:
    symbol = "l_returnflag AS symbol," if keys else ""
    sym = "symbol," if keys else ""
    part = "session_date" + (", symbol" if keys else "")
    return f"""
priced AS (
  SELECT CAST(l_shipdate AS DATE) AS session_date, {symbol} l_orderkey, l_linenumber, l_partkey,
         l_extendedprice, l_quantity, l_discount, l_tax,
         100 * pow(l_extendedprice / l_quantity / 1500, 0.02) AS p
  FROM lineitem),
ohlc AS (
  SELECT *, {six('p')} AS o, {six('p * (1 + l_tax / 10)')} AS h, {six('p * (1 - l_discount / 10)')} AS l,
         {six('p * (1 + (l_tax - l_discount) / 20)')} AS c
  FROM priced),
ticks AS (
  SELECT session_date, {sym}
         row_number() OVER (PARTITION BY {part} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS m,
         count(*) OVER (PARTITION BY {part}) AS session_rows,
         o, h, l, c, l_quantity AS v, {six('(h + l + c) / 3')} AS vwap,
         {six('c * (1 - 0.0005 - l_discount / 100)')} AS bid, {six('c * (1 + 0.0005 + l_tax / 100)')} AS ask,
         l_quantity AS bid_size, CAST(l_linenumber * 10 AS DOUBLE) AS ask_size
  FROM ohlc)"""


def returns(keys: bool = False) -> str:
    part = "session_date" + (", symbol" if keys else "")
    return f"""
lagged AS (
  SELECT *, ln(c) - ln(lag(c) OVER w) AS r FROM ticks
  WINDOW w AS (PARTITION BY {part} ORDER BY m)),
returns AS (
  SELECT *, lag(abs(r)) OVER (PARTITION BY {part} ORDER BY m) AS r_lag FROM lagged)"""


def daily(keys: bool = False) -> str:
    part = "session_date" + (", symbol" if keys else "")
    over = "PARTITION BY symbol " if keys else ""
    return f"""
sums AS (
  SELECT {part}, coalesce(sum(r * r), 0) AS RV_daily, count(r) AS n_minutes,
         coalesce(sum(abs(r) * r_lag), 0) * {PI_HALF} AS BV_daily,
         sum(r * r * r) / nullif(pow(sum(r * r), 1.5), 0) AS realized_skew,
         sum(r * r * r * r) / nullif(sum(r * r) * sum(r * r), 0) AS realized_kurt,
         coalesce(sum(CASE WHEN r < 0 THEN r * r END), 0) AS downside_var,
         coalesce(sum(CASE WHEN r > 0 THEN r * r END), 0) AS upside_var,
         min_by(o, m) AS daily_open, max(h) AS daily_high, min(l) AS daily_low, max_by(c, m) AS daily_close,
         sum(v) AS daily_volume, coalesce(sum(r), 0) AS daily_return_sum,
         max_by(c, m) / min_by(c, m) - 1 AS daily_return
  FROM returns GROUP BY {part}),
measures AS (
  SELECT *, greatest(RV_daily - BV_daily, 0) AS JV_daily FROM sums),
daily AS (
  SELECT *, JV_daily / nullif(RV_daily, 0) AS jump_ratio, sqrt(RV_daily) AS RVol_daily, sqrt(BV_daily) AS BVol_daily,
         sqrt(JV_daily) AS JVol_daily, sqrt(RV_daily * 252) AS RVol_annual,
         CASE WHEN RV_daily > 0 THEN ln(RV_daily) END AS log_RV_daily,
         pow(ln(daily_high / daily_low), 2) / (4 * ln(2)) AS parkinson_var,
         0.5 * pow(ln(daily_high / daily_low), 2) - (2 * ln(2) - 1) * pow(ln(daily_close / daily_open), 2)
           AS garman_klass_var,
         ln(daily_high / daily_close) * ln(daily_high / daily_open)
           + ln(daily_low / daily_close) * ln(daily_low / daily_open) AS rogers_satchell_var,
         (daily_high - daily_low) / daily_close AS daily_range,
         downside_var / nullif(upside_var, 0) AS variance_ratio,
         ln(daily_open / lag(daily_close) OVER ({over}ORDER BY session_date)) AS overnight_gap,
         row_number() OVER ({over}ORDER BY session_date) AS n
  FROM measures)"""


TICKS = bars()
RETURNS = TICKS + "," + returns()
DAILY = RETURNS + "," + daily()


def ewm(x: str, alpha: str, name: str, source: str = "daily") -> str:
    """CTE ``name``(n, y): bias-adjusted decayed mean of x by explicit weights."""
    return f"""
{name} AS (
  SELECT a.n, sum(b.x * pow(1 - {alpha}, a.n - b.n)) / sum(pow(1 - {alpha}, a.n - b.n)) AS y
  FROM (SELECT n FROM {source}) a LEFT JOIN (SELECT n, {x} AS x FROM {source} WHERE ({x}) IS NOT NULL) b
    ON b.n <= a.n AND b.n > a.n - ceil(ln(1e-18) / ln(1 - {alpha}))
  GROUP BY a.n)"""


def recursive(x: str, alpha: str, name: str, source: str = "daily") -> str:
    """CTE ``name``(n, y): y = (1-a) y + a x from the first row on, as an explicit weighted sum."""
    return f"""
{name} AS (
  SELECT a.n, sum(b.x * pow(1 - {alpha}, a.n - b.n) * CASE WHEN b.n = 1 THEN 1 ELSE {alpha} END) AS y
  FROM (SELECT n FROM {source}) a JOIN (SELECT n, {x} AS x FROM {source}) b ON b.n <= a.n
    AND b.n > a.n - ceil(ln(1e-18) / ln(1 - {alpha}))
  GROUP BY a.n)"""


def frame(n: int, extra: str = "ORDER BY session_date") -> str:
    return f"({extra} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """Rolling aggregate with a minimum number of values; ``agg`` has a {{}} for the input."""
    least = n if least is None else least
    value = f"{agg.format(x)} OVER {frame(n)}"
    if least <= 1:
        return value
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {least} THEN {value} END"


def mean(x, n, least=None):
    return roll("avg({})", x, n, least)


def std(x, n, least=None):
    return roll("stddev_samp({})", x, n, least)


def quantile(x, q, n, least=None):
    return roll("quantile_cont({}, " + str(q) + ")", x, n, least)
