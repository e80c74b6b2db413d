"""Registered queries of the analysis, and the DuckDB SQL that gives the same rows.

SQL has no log1p: it uses ln(1 + x). Figures that logarithms or medians enter
are rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import text as X
from tidemark.operators import checks as C
from tidemark.operators import history as H
from tidemark.operators import preprocess as P
from tidemark.plans import cross_source as S
from tidemark.plans import refresh as U
from tidemark.plans import report as R
from tidemark.plans import results as E
from tidemark.plans import verdict as V
from tidemark.sources import tables as T

POINT = ["series_id", "ts", "value", "contributors", "raw_count", "imputed"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def regular(spark: SparkSession, sf_dir: str, raw=T.events_daily) -> DataFrame:
    return P.preprocess(raw(spark, sf_dir))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.orders(spark, sf_dir, "D")


def events_points(spark, sf_dir):
    return rounded(T.events_daily(spark, sf_dir).select(*POINT, "top_share"), "top_share")


def orders_weekly(spark, sf_dir):
    return rounded(T.orders(spark, sf_dir, "W").select(*POINT, "top_share"), "top_share")


def shipments_monthly(spark, sf_dir):
    return rounded(T.shipments(spark, sf_dir, "M").select(*POINT, "top_share"), "top_share")


def windows_of(points: DataFrame) -> DataFrame:
    keep = ["n", "n_observed", "n_recent", "recent_start", "min_required", "sufficient"]
    out = points.groupBy("series_id").agg(*[F.first(c).alias(c) for c in keep], *[F.round(F.first(c), 6).alias(c) for c in ("median", "mad", "original_median", "original_mad")])
    return out.withColumns({c: F.col(c).cast("long") for c in keep[:-1]})


def events_windows(spark, sf_dir):
    return windows_of(regular(spark, sf_dir))


def orders_windows(spark, sf_dir):
    return windows_of(regular(spark, sf_dir, daily_orders))


def orders_gap_fill(spark, sf_dir):
    return regular(spark, sf_dir, daily_orders).select("series_id", "ts", "value", "was_filled", F.round("work_filled", 6).alias("work_filled"))


def orders_weekly_sums(spark, sf_dir):
    return P.weekly_sums(daily_orders(spark, sf_dir))


def orders_partial_month(spark, sf_dir):
    """Monthly series fetched on the day of their last order: that month is not over."""
    raw = T.orders(spark, sf_dir, "M")
    points = P.regular(P.without_partial(P.snapped(raw.withColumn("fetched_at", F.lit("2001-08-02").cast("timestamp")))))
    return points.groupBy("series_id").agg(F.max("ts").alias("last"), F.count("value").alias("n"), F.bool_or("dropped_partial").alias("dropped"))


def concentration(spark, sf_dir):
    return rounded(C.concentration(regular(spark, sf_dir), Settings()), "top1", "top2")


def outliers(spark, sf_dir):
    return rounded(C.outliers(regular(spark, sf_dir), Settings()), "max_z")


def breadth(spark, sf_dir):
    return rounded(C.breadth(regular(spark, sf_dir), Settings()), "share", "ratio")


def low_count(spark, sf_dir):
    return C.low_count(regular(spark, sf_dir, daily_orders), Settings()).select("series_id", "active", "k0", "n0", "k1", "n1")


def trend_pairs(spark, sf_dir):
    return rounded(C.trend_pairs(regular(spark, sf_dir), Settings()), "slope")


def trailing_run(spark, sf_dir):
    points = regular(spark, sf_dir)
    return C.trailing_run(points, C.trend_pairs(points, Settings()), Settings())


def verdicts_events(spark, sf_dir):
    return V.verdicts(T.events_daily(spark, sf_dir)).select(*V.SHORT)


def verdicts_all(spark, sf_dir):
    return V.verdicts(T.all_series(spark, sf_dir)).select(*V.SHORT)


def minimum_verdict(spark, sf_dir):
    """Last week against before, per event type, from expressions alone."""
    points, s = regular(spark, sf_dir), Settings()
    c = C.concentration(points, s).select("series_id", F.col("stance").alias("concentration"))
    o = C.outliers(points, s).select("series_id", F.col("stance").alias("outliers"), "n_flagged")
    label = F.when((F.col("concentration") == "supports_fluke") | ((F.col("concentration") == "skipped") & (F.col("outliers") == "supports_fluke")), "FLUKE").when(F.col("n_flagged") == 0, "NO_OUTLIER").otherwise("OTHER")
    return c.join(o, "series_id").withColumn("label", label)


def windows_for_comparison(spark, sf_dir) -> DataFrame:
    """Recent windows of all trade series; outcomes are stand-ins that SQL can state."""
    rows = []
    for freq, step in (("D", 1), ("W", 7)):
        p = P.preprocess(T.orders(spark, sf_dir, freq).unionByName(T.shipments(spark, sf_dir, freq)))
        rows.append(p.where("segment = 'recent'").groupBy("series_id").agg(F.min("ts").alias("start"), F.date_add(F.max("ts"), step).alias("end"), F.max("n_recent").alias("k")))
    w = rows[0].unionByName(rows[1])
    outcome = F.when(F.substring("series_id", 1, 1) == "o", "NO_CHANGE").when(F.col("series_id").endswith("A"), "FLUKE").otherwise("TREND up")
    return w.select(F.substring_index(F.substring_index("series_id", "/", 2), "/", -1).alias("topic"), F.col("series_id").alias("source"), "start", "end", outcome.alias("outcome"))


def cross_source(spark, sf_dir):
    return S.compare_sources(windows_for_comparison(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def source_sentences(spark, sf_dir):
    """Verdicts of all series, compared and told per topic in a sentence."""
    return R.topic_sentences(S.source_windows(V.verdicts(T.all_series(spark, sf_dir)))).withColumn("sources", F.array_join("sources", ","))


def verdict_texts(spark, sf_dir):
    """Event verdicts with their badge and what would change them, in words."""
    return R.with_texts(V.verdicts(T.events_daily(spark, sf_dir))).select("series_id", "badge", F.array_join("condition_texts", " ").alias("conditions"))


def topic_table(spark, sf_dir):
    return R.topic_table(manifest(spark, sf_dir), ["automobile", "building", "furniture", "household", "machinery"])


def history_merge(spark, sf_dir):
    """A refresh that begins on 2001-06-01 over an older copy with other values, the last 365 days of both."""
    now = daily_orders(spark, sf_dir).select("series_id", "source", "freq", "scale", "ts", "value")
    old = now.where("ts < date'2001-07-01'").withColumn("value", F.col("value") + 100)
    return H.merge_history(old, now.where("ts >= date'2001-06-01'"), 365).select("series_id", "ts", "value")


def history_upsert(spark, sf_dir):
    now = daily_orders(spark, sf_dir).select("series_id", "ts", "value")
    late = now.where("ts >= date'2001-07-01'").withColumn("value", F.col("value") * 2)
    return H.upsert(now, late, ["series_id", "ts"])


def manifest(spark, sf_dir):
    """Customers by nation as entries: a new run over an older one, for some topics."""
    c = T.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("topic"), F.lower("c_mktsegment").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    run = c.where("source <> 'building'").withColumn("status", F.when(F.col("n") > 2, "ok").otherwise("failed"))
    keep = T.read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("topic"))
    return H.manifest(c.withColumn("status", F.lit("ok")).withColumn("n", F.lit(0).cast("long")), run, keep)


def status_by_source(spark, sf_dir):
    return H.source_status(manifest(spark, sf_dir))


def refresh_entries(spark, sf_dir):
    """A refresh of orders by priority and status: one source answers nothing, one topic is new, one has not changed since."""
    o = T.read(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("topic"), F.lower("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    now = o.select(F.concat_ws("/", "source", "topic").alias("series_id"), "topic", "source", F.lit("D").alias("freq"), F.lit("count").alias("scale"), "ts", "value")
    last = now.groupBy("series_id").agg(F.max("ts").alias("last"))
    stored = now.join(last, "series_id").where("topic <> '5' and case when topic = '2' then ts > date_sub(last, 365) else ts < date'2001-07-01' end").drop("last").withColumn("fetched_at", F.lit("2001-07-01").cast("timestamp"))
    fresh = now.where("ts >= date'2001-06-01' and source <> 'p'").withColumn("fetched_at", F.lit("2001-08-01").cast("timestamp"))
    asked = now.select("series_id", "topic", "source").distinct()
    faults = asked.where("source = 'p'").select("series_id", F.lit("no answer").alias("error"), (F.col("topic") == "3").alias("disabled"))
    _, entries = U.refresh(stored, fresh, faults, asked, 365)
    return entries.select("topic", "source", "status", F.to_date("fetched_at").alias("fetched"), "points", "error")


def name_functions(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", X.slugify(F.concat_ws("  ", "p_name", F.lit("(X)!"))).alias("slug"), X.normalised_query(F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t z "))).alias("query"), X.cache_key(F.lit("hn"), F.col("p_name"), F.lit("{}")).alias("key"))


def narrations(spark, sf_dir):
    """A paragraph per event verdict, and how much in it the verdict does not license."""
    return E.told(T.events_daily(spark, sf_dir)).select("series_id", F.col("narration").alias("text"), F.size("issues").alias("n_unlicensed"))


def result_json(spark, sf_dir):
    """A summary row per topic and a card row per event series."""
    return E.results(T.events_daily(spark, sf_dir))


def chart_json(spark, sf_dir):
    """A JSON document per event series: observed points, window and baseline, as a chart needs them."""
    p = regular(spark, sf_dir)
    at = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct(F.date_format("ts", "yyyy-MM-dd").alias("ts"), "value"))))
    doc = p.groupBy("series_id").agg(at(F.col("value").isNotNull() & ~F.col("imputed")).alias("observed"), at(F.col("imputed")).alias("imputed"), F.min(F.when(F.col("segment") == "recent", F.date_format("ts", "yyyy-MM-dd"))).alias("window_start"), F.first("original_median").alias("median"))
    return doc.select("series_id", F.to_json(F.struct("observed", "imputed", "window_start", "median")).alias("json"))


ITEMS = {
    "events": "SELECT 'events/' || event_type AS id, ts::DATE AS ts, user_id AS who FROM events",
    "orders_d": "SELECT 'orders/D/' || substr(o_orderpriority, 1, 1) AS id, o_orderdate::DATE AS ts, o_custkey AS who FROM orders",
    "orders_w": "SELECT 'orders/W/' || substr(o_orderpriority, 1, 1) AS id, date_trunc('week', o_orderdate)::DATE AS ts, o_custkey AS who FROM orders",
    "orders_m": "SELECT 'orders/M/' || substr(o_orderpriority, 1, 1) AS id, date_trunc('month', o_orderdate)::DATE AS ts, o_custkey AS who FROM orders",
    "lines_d": "SELECT 'lines/D/' || l_returnflag AS id, l_shipdate::DATE AS ts, l_suppkey AS who FROM lineitem",
    "lines_w": "SELECT 'lines/W/' || l_returnflag AS id, date_trunc('week', l_shipdate)::DATE AS ts, l_suppkey AS who FROM lineitem",
    "lines_m": "SELECT 'lines/M/' || l_returnflag AS id, date_trunc('month', l_shipdate)::DATE AS ts, l_suppkey AS who FROM lineitem",
}


def sql_points(items: str, fill: str | None) -> str:
    """CTE p: points of a source; fill: interval of the calendar that zero-fills it."""
    base = f"""i AS ({ITEMS[items]}),
k AS (SELECT id, ts, who, count(*) AS n FROM i GROUP BY ALL),
q AS (SELECT id AS series_id, ts, sum(n)::DOUBLE AS value, count(who)::BIGINT AS contributors, sum(n)::BIGINT AS raw_count, max(n) / sum(n) AS top_share, false AS imputed FROM k GROUP BY ALL)"""
    if not fill:
        return base + ",\np AS (SELECT * FROM q)"
    return base + f""",
e AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM q GROUP BY ALL),
d AS (SELECT series_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL '{fill}'))::DATE AS ts FROM e),
p AS (SELECT series_id, ts, coalesce(value, 0) AS value, contributors, raw_count, top_share, value IS NULL AS imputed FROM d LEFT JOIN q USING (series_id, ts))"""


def sql_windows(items: str, fill: str | None, step: str = "1 day", bounds=(28, 7, 28)) -> str:
    """CTE w: regular points with positions, windows and baseline statistics."""
    history, least, most = bounds
    return sql_points(items, fill) + f""",
c AS (SELECT series_id, unnest(generate_series(min(ts)::TIMESTAMP, max(ts)::TIMESTAMP, INTERVAL '{step}'))::DATE AS ts FROM p GROUP BY series_id),
r AS (SELECT series_id, ts, value, contributors, raw_count, top_share, coalesce(imputed, false) AS imputed, ln(1 + value) AS work,
        row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, count(value) OVER (PARTITION BY series_id) AS n_observed
      FROM c LEFT JOIN p USING (series_id, ts)),
v AS (SELECT *, least(greatest(floor(0.2 * n + 0.5)::BIGINT, {least}), {most}) AS n_recent, {history} AS min_required, n_observed >= {history} AS sufficient FROM r),
b AS (SELECT *, n - n_recent AS recent_start, CASE WHEN idx < n - n_recent THEN 'baseline' ELSE 'recent' END AS segment FROM v),
m AS (SELECT series_id, median(work) AS median, median(value) AS original_median FROM b WHERE segment = 'baseline' GROUP BY ALL),
g AS (SELECT b.series_id, any_value(median) AS median, any_value(original_median) AS original_median,
        1.4826 * median(abs(work - median)) AS spread, 1.4826 * median(abs(value - original_median)) AS original_spread
      FROM b JOIN m USING (series_id) WHERE segment = 'baseline' GROUP BY ALL),
w AS (SELECT b.*, median, original_median, CASE WHEN spread = 0 THEN 0.05 * greatest(median, 1) ELSE spread END AS mad,
        CASE WHEN original_spread = 0 THEN 0.05 * greatest(original_median, 1) ELSE original_spread END AS original_mad
      FROM b JOIN g USING (series_id))"""


POINT_SQL = "SELECT series_id, ts, value, contributors, raw_count, imputed, round(top_share, 6) AS top_share FROM p"
WINDOW_SQL = """SELECT series_id, any_value(n) AS n, any_value(n_observed) AS n_observed, any_value(n_recent)::BIGINT AS n_recent, any_value(recent_start)::BIGINT AS recent_start,
  any_value(min_required)::BIGINT AS min_required, any_value(sufficient) AS sufficient, round(any_value(median), 6) AS median, round(any_value(mad), 6) AS mad,
  round(any_value(original_median), 6) AS original_median, round(any_value(original_mad), 6) AS original_mad FROM w GROUP BY series_id"""
CONCENTRATION = """,
x AS (SELECT *, work - median AS excess, sum(work - median) OVER (PARTITION BY series_id) AS total FROM w WHERE segment = 'recent' AND sufficient AND work IS NOT NULL),
y AS (SELECT *, greatest(CASE WHEN total > 0 THEN excess ELSE -excess END, 0) AS part FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY part DESC, idx) AS place FROM y),
cn AS (SELECT series_id, abs(any_value(total)) >= any_value(mad) * count(*) AS ran, any_value(total) AS total,
         sum(part) FILTER (place <= 1) / nullif(sum(part), 0) AS top1, sum(part) FILTER (place <= 2) / nullif(sum(part), 0) AS top2, max(ts) FILTER (place = 1) AS top1_ts FROM z GROUP BY series_id),
conc AS (SELECT series_id, CASE WHEN NOT ran THEN 'skipped' WHEN top1 >= 0.4 OR top2 >= 0.8 THEN 'supports_fluke' ELSE 'neutral' END AS stance,
           CASE WHEN ran THEN CASE WHEN total > 0 THEN 'up' ELSE 'down' END END AS direction, CASE WHEN ran THEN round(top1, 6) END AS top1,
           CASE WHEN ran THEN round(top2, 6) END AS top2, CASE WHEN ran THEN top1_ts END AS top1_ts FROM cn)"""
OUTLIERS = """,
o AS (SELECT *, (work - median) / mad AS z FROM w WHERE segment = 'recent' AND sufficient AND work IS NOT NULL),
outl AS (SELECT series_id, CASE WHEN n_flagged = 0 THEN 'supports_no_change' WHEN n_flagged <= 2 THEN 'supports_fluke' ELSE 'neutral' END AS stance, n_flagged, max_z,
           CASE WHEN top > 0 THEN 'up' WHEN top < 0 THEN 'down' END AS direction, top_ts AS ts
         FROM (SELECT series_id, count(*) FILTER (abs(z) >= 3.5) AS n_flagged, round(max(abs(z)), 6) AS max_z,
                 arg_max(z, (abs(z), -idx)) FILTER (abs(z) >= 3.5) AS top, arg_max(ts, (abs(z), -idx)) FILTER (abs(z) >= 3.5) AS top_ts FROM o GROUP BY series_id))"""
PAIRS = """,
s AS (SELECT series_id, idx, work FROM w WHERE sufficient AND work IS NOT NULL AND idx >= recent_start - least(7, recent_start)),
pairs AS (SELECT a.series_id, sum(sign(b.work - a.work))::BIGINT AS s, median((b.work - a.work) / (b.idx - a.idx)) AS slope, count(*) AS pairs
          FROM s a JOIN s b ON a.series_id = b.series_id AND a.idx < b.idx GROUP BY ALL HAVING count(*) >= 10)"""
MANIFEST = """c AS (SELECT c_nationkey::VARCHAR AS topic, lower(c_mktsegment) AS source, count(*) AS n FROM customer GROUP BY ALL),
k AS (SELECT n_nationkey::VARCHAR AS topic FROM nation WHERE n_regionkey < 3),
m AS (SELECT topic, source, CASE WHEN source = 'building' THEN 'ok' WHEN n > 2 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN source = 'building' THEN 0 ELSE n END AS n
      FROM c WHERE topic IN (SELECT topic FROM k))"""


def sql_compare() -> str:
    part = []
    for freq, step, days, bounds in (("d", "1 day", 1, (28, 7, 28)), ("w", "7 day", 7, (26, 4, 13))):
        for table in ("orders", "lines"):
            w = sql_windows(f"{table}_{freq}", None if table == "orders" else step, step, bounds)
            part.append(f"(WITH {w} SELECT series_id, min(ts) AS s, max(ts) + {days} AS e FROM w WHERE segment = 'recent' GROUP BY ALL)")
    return f"""WITH a AS ({' UNION ALL '.join(part)}),
l AS (SELECT split_part(series_id, '/', 2) AS topic, series_id AS source, s::DATE AS s, e::DATE AS e,
        CASE WHEN series_id LIKE 'o%' THEN 'NO_CHANGE' WHEN series_id LIKE '%A' THEN 'FLUKE' ELSE 'TREND up' END AS outcome,
        min(date_diff('day', s::DATE, e::DATE)) OVER (PARTITION BY split_part(series_id, '/', 2)) AS days FROM a),
t AS (SELECT l.*, x.e AS anchor, greatest(date_diff('day', greatest(s, x.e - days::INTEGER), least(l.e, x.e)), 0) / days AS share
      FROM l JOIN (SELECT DISTINCT topic, e FROM l) x ON x.topic = l.topic),
b AS (SELECT topic, anchor, count(*) FILTER (share >= 0.5) AS n, min(e) FILTER (share >= 0.5) AS first_end FROM t GROUP BY ALL),
h AS (SELECT topic, arg_max(first_end, (n, anchor)) AS anchor FROM b GROUP BY topic),
f AS (SELECT l.*, h.anchor, round(greatest(date_diff('day', greatest(s, anchor - days::INTEGER), least(e, anchor)), 0) / days, 4) >= 0.5 AS compared FROM l JOIN h USING (topic)),
n AS (SELECT topic, outcome, count(*) AS k, list_position(['TREND up', 'TREND down', 'FLUKE', 'SEASONAL', 'NO_CHANGE', 'INCONCLUSIVE'], outcome) AS o FROM f WHERE compared GROUP BY ALL),
d AS (SELECT topic, arg_max(outcome, (k, -o)) AS lead, max(k) AS n_lead, count(*) AS n_outcomes FROM n GROUP BY topic)
SELECT f.topic, 0::BIGINT AS n_unavailable, max(anchor) AS window_end, max(days)::BIGINT AS days, count(*) FILTER (compared) AS n_compared, count(*) FILTER (NOT compared) AS n_apart,
  string_agg(source, ',' ORDER BY source) FILTER (compared) AS sources, any_value(lead) AS lead, any_value(n_lead) AS n_lead, any_value(n_outcomes) AS n_outcomes,
  CASE WHEN count(*) FILTER (compared) < 2 THEN 'not comparable' WHEN any_value(n_outcomes) = 1 THEN 'agree' ELSE 'differ' END AS agreement
FROM f LEFT JOIN d USING (topic) GROUP BY f.topic"""


#: Dates are given as text, which every engine's client shows alike.
DATES = {"top1_ts": ["concentration"], "last": ["orders_partial_month"], "window_end": ["cross_source"], "ts": ["events_points", "orders_weekly", "shipments_monthly", "orders_gap_fill", "orders_weekly_sums", "outliers", "history_merge", "history_upsert"]}


def dated(query):
    """The query with its dates as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "date"})

    return run


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    named = {q: c for c, qs in DATES.items() for q in qs}
    return {k: f"SELECT * REPLACE ({named[k]}::DATE::VARCHAR AS {named[k]}) FROM ({v})" if k in named else v for k, v in plain_sql().items()}


def plain_sql() -> dict[str, str]:
    ev, od = sql_windows("events", "1 day"), sql_windows("orders_d", None)
    return {
        "events_points": f"WITH {sql_points('events', '1 day')} {POINT_SQL}",
        "orders_weekly": f"WITH {sql_points('orders_w', None)} {POINT_SQL}",
        "shipments_monthly": f"WITH {sql_points('lines_m', '1 month')} {POINT_SQL}",
        "events_windows": f"WITH {ev} {WINDOW_SQL}",
        "orders_windows": f"WITH {od} {WINDOW_SQL}",
        "orders_gap_fill": f"""WITH {od},
f AS (SELECT *, max(idx) FILTER (work IS NOT NULL) OVER (PARTITION BY series_id ORDER BY idx) AS ia, min(idx) FILTER (work IS NOT NULL) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM w)
SELECT f.series_id, f.ts, f.value, f.work IS NULL AND coalesce(ib - ia - 1 <= 2, false) AS was_filled,
  round(CASE WHEN f.work IS NULL AND ib - ia - 1 <= 2 THEN a.work + (b.work - a.work) * (f.idx - ia) / (ib - ia) ELSE f.work END, 6) AS work_filled
FROM f LEFT JOIN w a ON a.series_id = f.series_id AND a.idx = ia LEFT JOIN w b ON b.series_id = f.series_id AND b.idx = ib""",
        "orders_weekly_sums": f"WITH {sql_points('orders_d', None)} SELECT series_id, date_trunc('week', ts)::DATE AS ts, sum(value) AS value, bool_or(imputed) AS imputed FROM p GROUP BY ALL HAVING count(value) = 7",
        "orders_partial_month": f"WITH {sql_points('orders_m', None)} SELECT series_id, max(ts) FILTER (ts < DATE '2001-08-01') AS last, count(*) FILTER (ts < DATE '2001-08-01') AS n, max(ts) >= DATE '2001-08-01' AS dropped FROM p GROUP BY series_id",
        "concentration": f"WITH {ev}{CONCENTRATION} SELECT * FROM conc",
        "outliers": f"WITH {ev}{OUTLIERS} SELECT * FROM outl",
        "breadth": f"""WITH {ev},
t AS (SELECT series_id, sum(value * top_share) FILTER (top_share IS NOT NULL AND value > 0) / sum(value) FILTER (top_share IS NOT NULL AND value > 0) AS share,
        sum(contributors) FILTER (coalesce(raw_count, value) > 0) / sum(coalesce(raw_count, value)) FILTER (contributors IS NOT NULL AND coalesce(raw_count, value) > 0) AS ratio
      FROM w WHERE segment = 'recent' AND sufficient GROUP BY ALL)
SELECT series_id, round(share, 6) AS share, round(ratio, 6) AS ratio, CASE WHEN share IS NULL AND ratio IS NULL THEN 'skipped' WHEN coalesce(share >= 0.5, false) OR coalesce(ratio < 0.3, false) THEN 'supports_fluke' ELSE 'neutral' END AS stance FROM t""",
        "low_count": f"""WITH {od},
t AS (SELECT series_id, avg(value) FILTER (segment = 'baseline') AS mean, coalesce(sum(round_even(value, 0)) FILTER (segment = 'baseline'), 0)::BIGINT AS k0, count(value) FILTER (segment = 'baseline') AS n0,
        coalesce(sum(round_even(value, 0)) FILTER (segment = 'recent'), 0)::BIGINT AS k1, count(value) FILTER (segment = 'recent') AS n1 FROM w WHERE sufficient GROUP BY ALL)
SELECT series_id, coalesce(mean < 5 AND k0 + k1 > 0 AND n1 > 0, false) AS active, k0, n0, k1, n1 FROM t""",
        "trend_pairs": f"WITH {ev}{PAIRS} SELECT series_id, s, round(slope, 6) AS slope, pairs FROM pairs",
        "trailing_run": f"""WITH {ev}{PAIRS},
t AS (SELECT w.series_id, w.idx, w.n, coalesce(CASE WHEN slope > 0 THEN work > median + 2 * mad WHEN slope < 0 THEN work < median - 2 * mad END, false) AS beyond FROM w JOIN pairs USING (series_id) WHERE w.idx >= w.recent_start - least(7, w.recent_start))
SELECT series_id, (any_value(n) - 1 - coalesce(max(idx) FILTER (NOT beyond), min(idx) - 1))::BIGINT AS run FROM t GROUP BY series_id""",
        "minimum_verdict": f"""WITH {ev}{CONCENTRATION}{OUTLIERS}
SELECT conc.series_id, conc.stance AS concentration, outl.stance AS outliers, outl.n_flagged,
  CASE WHEN conc.stance = 'supports_fluke' OR (conc.stance = 'skipped' AND outl.stance = 'supports_fluke') THEN 'FLUKE' WHEN n_flagged = 0 THEN 'NO_OUTLIER' ELSE 'OTHER' END AS label
FROM conc JOIN outl USING (series_id)""",
        "cross_source": sql_compare(),
        "history_merge": f"""WITH {sql_points('orders_d', None)},
f AS (SELECT series_id, ts, value FROM p WHERE ts >= DATE '2001-06-01'), s AS (SELECT series_id, min(ts) AS first FROM f GROUP BY ALL),
u AS (SELECT series_id, ts, value FROM f UNION ALL SELECT p.series_id, p.ts, p.value + 100 FROM p LEFT JOIN s USING (series_id) WHERE p.ts < DATE '2001-07-01' AND (first IS NULL OR p.ts < first))
SELECT series_id, ts, value FROM (SELECT *, max(ts) OVER (PARTITION BY series_id) AS last FROM u) WHERE ts > last - 365""",
        "history_upsert": f"WITH {sql_points('orders_d', None)} SELECT series_id, ts, CASE WHEN ts >= DATE '2001-07-01' THEN 2 * value ELSE value END AS value FROM p",
        "manifest": f"WITH {MANIFEST} SELECT * FROM m",
        "topic_table": f"WITH {MANIFEST} SELECT topic, " + ", ".join(f"coalesce(max(status) FILTER (source = '{k}'), '—') AS {k}" for k in ("automobile", "building", "furniture", "household", "machinery")) + " FROM m GROUP BY topic",
        "chart_json": f"""WITH {ev}
SELECT series_id, to_json({{observed: coalesce(list({{ts: strftime(ts, '%Y-%m-%d'), value: value}} ORDER BY ts) FILTER (value IS NOT NULL AND NOT imputed), []), imputed: coalesce(list({{ts: strftime(ts, '%Y-%m-%d'), value: value}} ORDER BY ts) FILTER (imputed), []),
  window_start: min(strftime(ts, '%Y-%m-%d')) FILTER (segment = 'recent'), median: any_value(original_median)}})::VARCHAR AS json FROM w GROUP BY series_id""",
        "refresh_entries": """WITH n AS (SELECT substr(o_orderpriority, 1, 1) AS topic, lower(o_orderstatus) AS source, o_orderdate::DATE AS ts FROM orders GROUP BY ALL),
m AS (SELECT *, max(ts) OVER (PARTITION BY topic, source) AS last FROM n),
k AS (SELECT topic, source, count(*) FILTER (CASE WHEN topic = '5' THEN false WHEN topic = '2' THEN ts > last - 365 ELSE ts < DATE '2001-07-01' END) AS stored,
        count(*) FILTER (ts >= DATE '2001-06-01') AS fetched, count(*) FILTER (ts > last - 365 AND (topic <> '5' OR ts >= DATE '2001-06-01')) AS merged FROM m GROUP BY ALL),
e AS (SELECT *, CASE WHEN source = 'p' AND topic = '3' THEN 'skipped' WHEN source = 'p' OR fetched = 0 THEN 'failed' WHEN topic = '2' THEN 'unchanged' ELSE 'updated' END AS status FROM k)
SELECT topic, source, status, CASE WHEN status = 'updated' THEN '2001-08-01' WHEN stored > 0 THEN '2001-07-01' END AS fetched, CASE WHEN status = 'updated' THEN merged WHEN stored > 0 THEN stored END AS points,
  CASE WHEN source = 'p' THEN 'Couldn''t fetch P: no answer' WHEN fetched = 0 THEN upper(source) || ': nothing was fetched' END AS error FROM e""",
        "status_by_source": f"WITH {MANIFEST} SELECT source, CASE WHEN count(*) FILTER (status = 'ok') > 0 AND count(*) FILTER (status = 'failed') > 0 THEN 'partial' WHEN count(*) FILTER (status = 'ok') > 0 THEN 'ok' ELSE 'failed' END AS status FROM m GROUP BY source",
        "name_functions": r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || '  (X)!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  lower(trim(regexp_replace(' ' || upper(p_name) || chr(9) || ' z ', '\s+', ' ', 'g'))) AS query,
  'hn:' || sha256(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) || chr(31) || '{}') AS key FROM part""",
    }


QUERIES = {
    f.__name__: dated(f)
    for f in (
        events_points, orders_weekly, shipments_monthly, events_windows, orders_windows, orders_gap_fill, orders_weekly_sums, orders_partial_month,
        concentration, outliers, breadth, low_count, trend_pairs, trailing_run, minimum_verdict, verdicts_events, verdicts_all, cross_source, source_sentences, verdict_texts, topic_table,
        history_merge, history_upsert, manifest, status_by_source, refresh_entries, name_functions, narrations, result_json, chart_json,
    )
}
