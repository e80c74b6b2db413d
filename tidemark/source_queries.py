"""Queries that run the source contracts over the driver's tables, and their SQL.

Events stand for page views, posts and day counts, orders for stories: the
contracts are the same for any landed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import contracts as C
from tidemark.sources.tables import breadth, read


def points(df: DataFrame) -> DataFrame:
    return df.select("series_id", F.col("ts").cast("string").alias("ts"), "value", F.col("contributors").cast("long").alias("contributors"), F.round("top_share", 6).alias("top_share"), F.col("raw_count").cast("long").alias("raw_count"), "imputed")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("string").alias("author"), (F.col("user_id") % 7).cast("string").alias("place"))


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def page_views(spark, sf_dir):
    """Views of all days but Mondays; these come back as zero."""
    days = events(spark, sf_dir).where(F.weekday("ts") != 0).groupBy("series_id", F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("views"))
    return points(C.page_views(days.select("series_id", F.concat("day", F.lit("00")).alias("timestamp"), "views")))


def story_days(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("series_id"), F.to_date("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), "o_orderkey")
    counts = rows.groupBy("series_id", "ts").agg((F.count(F.lit(1)) + F.day(F.first("ts")) % 3).alias("n")).withColumn("approximate", F.day("ts") % 2 == 0)
    return C.story_points(counts, C.newest(rows, ["series_id", "ts"], 2, "o_orderkey"), 2)


def story_points(spark, sf_dir):
    """Orders as stories: counts of even days are estimates, a listing has the two newest of a day."""
    return points(story_days(spark, sf_dir)[0])


def story_caveats(spark, sf_dir):
    return story_days(spark, sf_dir)[1].select("series_id", F.array_join("caveats", "; ").alias("caveats"))


def capped_posts(spark, sf_dir):
    """A listing of the thousand newest events of a type, over January 2024."""
    return points(C.post_points(events(spark, sf_dir), 1000, "2024-01-01", "2024-01-31")[0])


def breadth_days(spark, sf_dir):
    days = events(spark, sf_dir).select("series_id", F.to_date("ts").alias("ts")).distinct()
    return C.breadth_days(days, F.lit("2024-01-20 12:00:00").cast("timestamp")).withColumn("ts", F.col("ts").cast("string"))


def counted_posts(spark, sf_dir):
    """Hourly counts, with the breadth of the fifty newest events of each recent day."""
    rows = events(spark, sf_dir)
    hours = rows.groupBy("series_id", F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return points(C.counted_posts(hours, rows, F.lit("2024-01-30 12:00:00").cast("timestamp"), 50))


def interest_granularity(spark, sf_dir):
    """How fine search interest would come for each customer's span of orders."""
    spans = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) + 1).alias("days"))
    return spans.select("o_custkey", "days", C.granularity(F.col("days")).alias("freq"))


def live_or_snapshot(spark, sf_dir):
    """Event days, for one type only from a snapshot."""
    days = breadth(events(spark, sf_dir).withColumn("ts", F.to_date("ts")), ["series_id", "ts"], "author").select("series_id", "ts", F.col("raw_count").cast("double").alias("value"))
    kept = days.withColumns({"value": F.col("value") * 2, "fetched_at": F.lit("2024-01-10").cast("timestamp")})
    rows, _ = C.live_or_snapshot(days.where("series_id <> 'error'"), kept, days.select("series_id", F.lit("blocked").alias("reason")).distinct(), F.lit("2024-02-01").cast("date"))
    return rows.withColumn("ts", F.col("ts").cast("string"))


def titles(spark, sf_dir):
    """Articles of nations: asked for by name for some, the customers of the nation as search results."""
    n, key, name = read(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_name")
    topics = n.select(name.alias("topic"), F.when(key % 4 == 0, F.concat(name, F.lit(" page"))).alias("override"))
    own = n.where(key % 3 == 0).select(name.alias("title"), F.when(key % 2 == 0, F.concat(name, F.lit(" land"))).alias("target"), F.lit(0).alias("ns"), F.lit(False).alias("missing"), (key % 6 == 3).alias("disambiguation"))
    asked = n.where(key % 8 == 0).select(F.concat(name, F.lit(" page")).alias("title"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("ns"), (key % 16 == 0).alias("missing"), F.lit(True).alias("disambiguation"))
    hits = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == key).select(name.alias("topic"), F.col("c_custkey").alias("rank"), F.col("c_name").alias("title"), (F.col("c_custkey") % 2 == 0).alias("disambiguation"))
    return C.resolved_titles(topics, own.unionByName(asked), hits)


EV = "e AS (SELECT event_type AS series_id, ts, ts::DATE AS day, user_id::VARCHAR AS author, (user_id % 7)::VARCHAR AS place FROM events)"
#: Days and their breadth, from rows r (series_id, day, author).
WIDE = """k AS (SELECT series_id, day, author, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT series_id, day, count(author) AS contributors, sum(n)::BIGINT AS raw_count, coalesce(max(n) FILTER (author IS NOT NULL), 0) / sum(n) AS top_share FROM k GROUP BY ALL)"""
LISTED = f"""o AS (SELECT substr(o_orderpriority, 1, 1) AS series_id, o_orderdate::DATE AS day, o_custkey AS author, row_number() OVER (PARTITION BY substr(o_orderpriority, 1, 1), o_orderdate::DATE ORDER BY o_orderkey) AS place FROM orders),
r AS (SELECT series_id, day, author FROM o WHERE place <= 2), {WIDE},
c AS (SELECT series_id, day, count(*) + day(day) % 3 AS n, day(day) % 2 = 0 AS guess FROM o GROUP BY series_id, day),
s AS (SELECT series_id, day, CASE WHEN guess AND raw_count < 2 THEN raw_count ELSE n END::DOUBLE AS value, guess AND raw_count >= 2 AS guess, contributors, top_share, raw_count FROM c JOIN b USING (series_id, day))"""
SQL = {
    "page_views": f"""WITH {EV}, v AS (SELECT series_id, day, count(*) AS n FROM e WHERE isodow(day) <> 1 GROUP BY ALL),
c AS (SELECT series_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL '1 day'))::DATE AS day FROM v GROUP BY series_id)
SELECT series_id, day::VARCHAR AS ts, coalesce(n, 0)::DOUBLE AS value, NULL::BIGINT AS contributors, NULL::DOUBLE AS top_share, NULL::BIGINT AS raw_count, n IS NULL AS imputed FROM c LEFT JOIN v USING (series_id, day)""",
    "story_points": f"WITH {LISTED} SELECT series_id, day::VARCHAR AS ts, value, contributors, round(top_share, 6) AS top_share, raw_count, false AS imputed FROM s",
    "story_caveats": f"""WITH {LISTED}, t AS (SELECT series_id, count(*) FILTER (guess) AS a, min(day) FILTER (guess) AS first, count(*) FILTER (raw_count < value) AS n FROM s GROUP BY ALL)
SELECT series_id, concat_ws('; ', CASE WHEN a > 0 THEN 'counts of ' || a || ' day(s) are estimates, the first on ' || first END, CASE WHEN n > 0 THEN 'breadth of ' || n || ' day(s) is told from the newest 2 items only' END) AS caveats FROM t WHERE a + n > 0""",
    "capped_posts": f"""WITH {EV}, l AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS nth, count(*) OVER (PARTITION BY series_id) AS total FROM e),
f AS (SELECT series_id, CASE WHEN any_value(total) > 1000 AND min(day) FILTER (nth <= 1000) >= DATE '2024-01-01' THEN min(day) FILTER (nth <= 1000) + 1 ELSE DATE '2024-01-01' END AS first FROM l GROUP BY series_id),
r AS (SELECT e.* FROM e JOIN f USING (series_id) WHERE day BETWEEN first AND DATE '2024-01-31'), {WIDE},
h AS (SELECT series_id, day, max(n) / sum(n) AS share FROM (SELECT series_id, day, place, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL),
d AS (SELECT series_id, unnest(generate_series(first::TIMESTAMP, TIMESTAMP '2024-01-31', INTERVAL '1 day'))::DATE AS day FROM f)
SELECT series_id, day::VARCHAR AS ts, coalesce(raw_count, 0)::DOUBLE AS value, coalesce(contributors, 0) AS contributors, round(greatest(top_share, share), 6) AS top_share, coalesce(raw_count, 0) AS raw_count, false AS imputed
FROM d LEFT JOIN b USING (series_id, day) LEFT JOIN h USING (series_id, day)""",
    "breadth_days": f"""WITH {EV}, d AS (SELECT DISTINCT series_id, day FROM e), o AS (SELECT *, day < DATE '2024-01-20' AS done FROM d),
n AS (SELECT *, count(*) FILTER (done) OVER (PARTITION BY series_id) AS n, count(*) FILTER (done) OVER (PARTITION BY series_id ORDER BY day) AS nth FROM o)
SELECT series_id, day::VARCHAR AS ts FROM n WHERE NOT done OR nth > n - least(greatest(floor(0.2 * n + 0.5), 7), 28)""",
    "counted_posts": f"""WITH {EV}, v AS (SELECT series_id, day, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT series_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL '1 day'))::DATE AS day FROM v GROUP BY series_id),
o AS (SELECT *, day < DATE '2024-01-30' AS done FROM c),
q AS (SELECT *, count(*) FILTER (done) OVER (PARTITION BY series_id) AS total, count(*) FILTER (done) OVER (PARTITION BY series_id ORDER BY day) AS nth FROM o),
w AS (SELECT series_id, day FROM q WHERE (NOT done OR nth > total - least(greatest(floor(0.2 * total + 0.5), 7), 28)) AND day >= TIMESTAMP '2024-01-23 12:00:00'),
l AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY ts DESC, author) AS nth FROM e),
r AS (SELECT l.series_id, l.day, author FROM l JOIN w USING (series_id, day) WHERE nth <= 50), {WIDE}
SELECT series_id, day::VARCHAR AS ts, coalesce(v.n, 0)::DOUBLE AS value, contributors, round(top_share, 6) AS top_share, raw_count, v.n IS NULL AS imputed FROM c LEFT JOIN v USING (series_id, day) LEFT JOIN b USING (series_id, day)""",
    "interest_granularity": "SELECT o_custkey, days, CASE WHEN days <= 90 THEN 'D' WHEN days <= 1825 THEN 'W' ELSE 'M' END AS freq FROM (SELECT o_custkey, (date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1)::INTEGER AS days FROM orders GROUP BY ALL)",
    "live_or_snapshot": f"WITH {EV} SELECT series_id, day::VARCHAR AS ts, count(*)::DOUBLE * CASE WHEN series_id = 'error' THEN 2 ELSE 1 END AS value FROM e GROUP BY series_id, day",
    "titles": """WITH f AS (SELECT c_nationkey AS n_nationkey, arg_min(c_name, c_custkey) AS found FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL),
t AS (SELECT n_name AS topic, n_nationkey % 4 = 0 AS asked, CASE WHEN n_nationkey % 4 = 0 THEN CASE WHEN n_nationkey % 8 = 0 AND n_nationkey % 16 <> 0 THEN n_name || ' page' END
        WHEN n_nationkey % 6 = 0 THEN n_name || ' land' ELSE found END AS title FROM nation LEFT JOIN f USING (n_nationkey))
SELECT topic, title, CASE WHEN title IS NULL THEN CASE WHEN asked THEN 'no article ' || topic || ' page' ELSE 'no article found for ' || topic END END AS reason FROM t""",
}
QUERIES = {f"source_{f.__name__}": f for f in (page_views, story_points, story_caveats, capped_posts, breadth_days, counted_posts, interest_granularity, live_or_snapshot, titles)}
ORACLES = {f"source_{k}": v for k, v in SQL.items()}
