"""Landed tables of each kind of source as daily points, with caveats.

A caveat is a row (series_id, caveat): what a reader of a series has to know
about it. Points have series_id, ts, value, contributors, top_share, raw_count
and imputed; tables.complete adds what the raw schema has besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.preprocess import recent_length
from tidemark.sources.tables import breadth, zero_filled

#: Authors that stand for none.
DELETED = ("[deleted]", "[removed]", "")
POINT = ["series_id", "ts", "value", "contributors", "top_share", "raw_count", "imputed"]


def history_range(start: Column, end: Column, days: int, today: Column) -> tuple[Column, Column]:
    """The inclusive range of a request: its end is today at most, its start so many days earlier where none is given."""
    last = F.least(F.coalesce(end, today), today)
    return F.coalesce(start, F.date_sub(last, days - 1)), last


def caveats_of(*parts: DataFrame) -> DataFrame:
    """(series_id, caveats): each series' caveats in the order of the parts, repeated ones once."""
    every = None
    for i, part in enumerate(parts):
        part = part.select("series_id", F.lit(i).alias("at"), "caveat")
        every = part if every is None else every.unionByName(part)
    kept = every.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("at", "caveat"))).alias("c"))
    return kept.select("series_id", F.array_distinct("c.caveat").alias("caveats"))


def resolved_titles(topics: DataFrame, titles: DataFrame, candidates: DataFrame) -> DataFrame:
    """(topic, title, reason) from topics (topic, override), titles (title, target, ns, missing, disambiguation) and candidates (topic, rank, title, disambiguation).

    The override's article where one is asked for (a disambiguation page will
    do), else the article of the topic's own name, else the first candidate.
    target is where a redirect leads. Without any, title is null and reason tells why.
    """
    known = titles.where(~F.coalesce("missing", F.lit(False)) & (F.coalesce("ns", F.lit(0)) == 0)).select("title", F.coalesce("target", "title").alias("canonical"), F.coalesce("disambiguation", F.lit(False)).alias("unclear"))
    own = known.where("not unclear").select(F.col("title").alias("topic"), F.col("canonical").alias("exact"))
    asked = known.select(F.col("title").alias("override"), F.col("canonical").alias("by_override"))
    first = candidates.where(~F.coalesce("disambiguation", F.lit(False))).groupBy("topic").agg(F.min(F.struct("rank", "title"))["title"].alias("found"))
    rows = topics.join(asked, "override", "left").join(own, "topic", "left").join(first, "topic", "left")
    title = F.when(F.col("override").isNotNull(), F.col("by_override")).otherwise(F.coalesce("exact", "found"))
    reason = F.when(title.isNull(), F.when(F.col("override").isNotNull(), F.concat(F.lit("no article "), "override")).otherwise(F.concat(F.lit("no article found for "), "topic")))
    return rows.select("topic", title.alias("title"), reason.alias("reason"))


def ordered_candidates(candidates: DataFrame, most: int) -> DataFrame:
    """(topic, titles): the first candidates of each topic that are no disambiguation pages."""
    place = F.row_number().over(Window.partitionBy("topic").orderBy("rank", "title"))
    rows = candidates.where(~F.coalesce("disambiguation", F.lit(False))).withColumn("place", place).where(F.col("place") <= most)
    return rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("t")).select("topic", F.col("t.title").alias("titles"))


def page_views(items: DataFrame) -> DataFrame:
    """Points from items (series_id, timestamp as yyyymmdd00, views): days without views, between the first and the last, are zero."""
    days = items.select("series_id", F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("ts"), F.col("views").cast("double").alias("value"))
    days = days.withColumns({"contributors": F.lit(None).cast("long"), "top_share": F.lit(None).cast("double"), "raw_count": F.lit(None).cast("long"), "imputed": F.lit(False)})
    return zero_filled(days).select(*POINT)


def breadth_days(days: DataFrame, now: Column, s: Settings | None = None) -> DataFrame:
    """Of days (series_id, ts), those worth the cost of breadth: the recent window of the complete ones, and any that is not over."""
    over = F.date_add("ts", 1).cast("timestamp") <= now
    by = Window.partitionBy("series_id")
    rows = days.withColumn("over", over).withColumns({"n": F.count_if("over").over(by), "nth": F.sum(F.col("over").cast("int")).over(by.orderBy("ts")), "freq": F.lit("D")})
    return rows.where(~F.col("over") | (F.col("nth") > F.col("n") - recent_length(F.col("n"), s or Settings()))).select("series_id", "ts")


def newest(items: DataFrame, keys: list[str], most: int, *order: str) -> DataFrame:
    """The newest items of each key: how many a listing gives."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), *order))
    return items.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def story_points(counts: DataFrame, hits: DataFrame, most: int, days: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, caveats) from day counts (series_id, ts, n, approximate) and the items listed for some days (series_id, ts, author).

    A listing holds the newest items, ``most`` at the most. Where a count is an
    estimate and the listing is shorter than it could be, its length is the
    count. Days whose listing is shorter than the count are sampled. days
    (series_id, ts): those that were listed; one of them without an item has no
    items and nobody behind them. By default they are those that have items.
    """
    listed = breadth(hits, ["series_id", "ts"], "author").withColumn("listed", F.lit(True))
    if days is not None:
        listed = days.select("series_id", "ts").distinct().join(listed.drop("listed"), ["series_id", "ts"], "left").withColumn("listed", F.lit(True))
        none = F.lit(0).cast("long")
        # Nobody holds a share of nothing.
        listed = listed.withColumns({"raw_count": F.coalesce("raw_count", none), "contributors": F.coalesce("contributors", none), "top_share": F.when(F.col("raw_count") > 0, F.col("top_share"))})
    rows = counts.join(listed, ["series_id", "ts"], "left")
    exact = F.coalesce("listed", F.lit(False)) & F.col("approximate") & (F.col("raw_count") < most)
    rows = rows.withColumns({"value": F.when(exact, F.col("raw_count")).otherwise(F.col("n")).cast("double"), "approximate": F.col("approximate") & ~exact})
    rows = rows.withColumns({"sampled": F.coalesce(F.col("raw_count") < F.col("value"), F.lit(False)), "imputed": F.lit(False)})
    per = rows.groupBy("series_id").agg(F.count_if("approximate").alias("a"), F.min(F.when(F.col("approximate"), F.col("ts"))).alias("first"), F.count_if("sampled").alias("s"))
    estimated = per.where("a > 0").select("series_id", F.format_string("counts of %d day(s) are estimates, the first on %s", "a", F.col("first").cast("string")).alias("caveat"))
    sampled = per.where("s > 0").select("series_id", F.format_string(f"breadth of %d day(s) is told from the newest {most} items only", "s").alias("caveat"))
    return rows.select(*POINT), caveats_of(estimated, sampled)


def post_points(posts: DataFrame, most: int, start: str, end: str, collected: DataFrame | None = None, series: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, coverage, caveats) from posts (series_id, ts timestamp, author, place), listed newest first, ``most`` at the most.

    series (series_id): what was asked; one without posts is covered and zero.
    By default they are those that have posts. Deleted authors are unknown ones.

    A listing that is full before it reaches start covers the days after that of
    its oldest post: that day is not whole. Days of the coverage without posts are
    zero. Share: of the largest author or place, the larger one. Collected days
    (series_id, ts, value, contributors, top_share) count before the coverage.
    """
    by = Window.partitionBy("series_id")
    posts = posts.withColumn("author", F.when(~F.col("author").isin(*DELETED), F.col("author")))
    listed = newest(posts, ["series_id"], most, "author", "place").withColumns({"day": F.col("ts").cast("date"), "n": F.count(F.lit(1)).over(by)})
    span = listed.groupBy("series_id").agg(F.min("day").alias("oldest"), F.max("n").alias("n"))
    capped = (F.col("n") >= most) & (F.col("oldest") >= F.lit(start).cast("date"))
    # Only a listing that a further post would not fit in is capped.
    total = posts.groupBy("series_id").agg(F.count(F.lit(1)).alias("all"))
    span = span.join(total, "series_id").withColumn("capped", capped & (F.col("all") > most))
    if series is not None:
        span = series.select("series_id").distinct().join(span, "series_id", "left").withColumn("capped", F.coalesce("capped", F.lit(False)))
    span = span.select("series_id", "capped", F.when(F.col("capped"), F.greatest(F.lit(start).cast("date"), F.date_add("oldest", 1))).otherwise(F.lit(start).cast("date")).alias("coverage_start"))
    span = span.withColumn("coverage_start", F.when(F.col("coverage_start") <= F.lit(end).cast("date"), F.col("coverage_start")))
    inside = listed.join(span, "series_id").where(F.col("day").between(F.col("coverage_start"), F.lit(end).cast("date"))).select("series_id", F.col("day").alias("ts"), "author", "place")
    authors = breadth(inside, ["series_id", "ts"], "author")
    places = breadth(inside, ["series_id", "ts"], "place").select("series_id", "ts", F.col("top_share").alias("place_share"))
    days = span.where("coverage_start is not null").select("series_id", F.explode(F.sequence("coverage_start", F.lit(end).cast("date"))).alias("ts"))
    live = days.join(authors, ["series_id", "ts"], "left").join(places, ["series_id", "ts"], "left")
    n = F.coalesce("raw_count", F.lit(0))
    live = live.select("series_id", "ts", n.cast("double").alias("value"), F.coalesce("contributors", F.lit(0)).alias("contributors"), F.greatest("top_share", "place_share").alias("top_share"), n.alias("raw_count"), F.lit(False).alias("imputed"))
    told = span.where("capped").select("series_id", F.concat(F.lit(f"the listing ended at {most} posts: live days begin on "), F.coalesce(F.col("coverage_start").cast("string"), F.lit("no day"))).alias("caveat"))
    if collected is None:
        return live, span, caveats_of(told)
    older = collected.join(span, "series_id", "left").where(F.col("coverage_start").isNull() | (F.col("ts") < F.col("coverage_start")))
    older = older.select("series_id", "ts", "value", F.col("contributors").cast("long").alias("contributors"), "top_share", F.col("value").cast("long").alias("raw_count"), F.lit(False).alias("imputed"))
    said = older.groupBy("series_id").agg(F.format_string("%d earlier day(s) were collected before", F.count(F.lit(1))).alias("caveat"))
    return live.unionByName(older), span, caveats_of(said, told)


def collected_days(spark, path: str) -> DataFrame:
    """Collected days from CSV files (date, count, contributors, top_share; a blank share is unknown), a series a file."""
    rows = spark.read.schema("date date, count double, contributors long, top_share double").option("header", True).csv(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.csv)?$", 1).alias("series_id"), F.col("date").alias("ts"), F.col("count").alias("value"), "contributors", "top_share")


def day_counts(buckets: DataFrame) -> DataFrame:
    """(series_id, ts, n) of buckets (series_id, start timestamp, n), which may be shorter than a day."""
    return buckets.groupBy("series_id", F.col("start").cast("date").alias("ts")).agg(F.sum("n").alias("n"))


def counted_posts(buckets: DataFrame, posts: DataFrame, now: Column, most: int, recent_days: int | None = None, search_days: int = 7) -> DataFrame:
    """Points from day buckets and, for recent days that the search still reaches, breadth of the newest ``most`` posts of a day.

    recent_days: where only that many days can be counted, earlier ones are not there. Days without a bucket are zero.
    """
    counts = day_counts(buckets)
    if recent_days is not None:
        counts = counts.where(F.col("ts").cast("timestamp") >= now - F.make_dt_interval(F.lit(recent_days)))
    counts = counts.select("series_id", "ts", F.col("n").cast("double").alias("value"), F.lit(False).alias("imputed"))
    filled = zero_filled(counts)
    reach = breadth_days(filled, now).where(F.col("ts").cast("timestamp") >= now - F.make_dt_interval(F.lit(search_days)))
    listed = newest(posts.withColumn("day", F.col("ts").cast("date")), ["series_id", "day"], most, "author").select("series_id", F.col("day").alias("ts"), "author")
    wide = breadth(listed.join(reach, ["series_id", "ts"], "left_semi"), ["series_id", "ts"], "author")
    return filled.join(wide, ["series_id", "ts"], "left").select(*POINT)


def granularity(days: Column, daily: int = 90, weekly: int = 1825) -> Column:
    """How fine search interest comes for a span of so many days."""
    return F.when(days <= daily, "D").when(days <= weekly, "W").otherwise("M")


def live_or_snapshot(live: DataFrame, snapshot: DataFrame, failures: DataFrame, now: Column, stale_days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(points, caveats): each series' live points, or those of its snapshot (with fetched_at) and why: failures has (series_id, reason)."""
    there = live.select("series_id").distinct()
    kept = snapshot.join(there, "series_id", "left_anti")
    aged = kept.groupBy("series_id").agg(F.datediff(now, F.max("fetched_at")).alias("days"))
    why = aged.join(failures, "series_id", "left").select("series_id", F.concat(F.lit("from a snapshot: "), F.coalesce("reason", F.lit("no live data"))).alias("caveat"))
    stale = aged.where(F.col("days") > stale_days).select("series_id", F.format_string("the snapshot is %d days old", "days").alias("caveat"))
    return live.unionByName(kept.select(*live.columns)), caveats_of(why, stale)
