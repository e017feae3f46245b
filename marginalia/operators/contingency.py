"""Features of names against items of posts: two-by-two counts over a set of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_features(universe: DataFrame, features: DataFrame, items: DataFrame, min_posts: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``universe(post)``, ``features(post, feature)``, ``items(post, item)`` to one row for each feature and item that
    enough posts have: posts with the feature, with both, without it, without it but with the item, shares of
    either side, base rate and the difference in points. A feature is held back unless ``min_posts`` posts have it and
    ``min_posts`` lack it. ``by`` names further key columns that all three carry, such as a reader.

    The joint counts come from one join on the post; pairs that never meet are kept by crossing the two key sets that
    passed, which are as many rows as the result.
    """
    by = list(by)
    key = [*by, "post"]
    universe = universe.select(*key).distinct()
    features = features.select(*key, "feature").distinct().join(universe, key, "left_semi")
    items = items.select(*key, "item").distinct().join(universe, key, "left_semi")
    total = universe.groupBy(*by).agg(F.count("*").alias("posts"))

    def with_total(df: DataFrame) -> DataFrame:
        return df.join(total, by) if by else df.crossJoin(total)  # one row, or one a key

    shown = with_total(features.groupBy(*by, "feature").agg(F.count("*").alias("with"))).filter((F.col("with") >= min_posts) & (F.col("posts") - F.col("with") >= min_posts))
    kept = items.groupBy(*by, "item").agg(F.count("*").alias("posts_and")).filter(F.col("posts_and") >= min_posts)
    joint = features.join(items, key).groupBy(*by, "feature", "item").agg(F.count("*").alias("with_and"))
    cells = (shown.join(kept, by) if by else shown.crossJoin(kept)).join(joint, [*by, "feature", "item"], "left").withColumn("with_and", F.coalesce("with_and", F.lit(0)).cast("long"))
    cells = cells.withColumn("without", F.col("posts") - F.col("with")).withColumn("without_and", F.col("posts_and") - F.col("with_and"))
    cells = cells.withColumn("share", F.col("with_and") / F.col("with")).withColumn("share_without", F.col("without_and") / F.col("without"))
    cells = cells.withColumn("base_rate", F.col("posts_and") / F.col("posts")).withColumn("points", 100 * (F.col("share") - F.col("share_without")))
    return cells.select(*by, "feature", "item", "posts", "with", "with_and", "share", "without", "without_and", "share_without", "posts_and", "base_rate", "points")


def held_back(universe: DataFrame, features: DataFrame, min_posts: int) -> DataFrame:
    """Features that too few posts have or too few lack."""
    inside = features.select("post", "feature").distinct().join(universe.select("post").distinct(), "post", "left_semi")
    total = universe.select("post").distinct().agg(F.count("*").alias("all"))
    counts = inside.groupBy("feature").agg(F.count("*").alias("posts")).crossJoin(F.broadcast(total))
    return counts.withColumn("without", F.col("all") - F.col("posts")).filter((F.col("posts") < min_posts) | (F.col("without") < min_posts)).select("feature", "posts", "without")


def from_signature(codings: DataFrame, posts: DataFrame) -> DataFrame:
    """``codings(lens, post, code, start)`` and ``posts(post, signature_at)``: per lens and code, posts that have the code
    and those that were quoted from the signature only."""
    first = codings.groupBy("lens", "code", "post").agg(F.min("start").alias("start"))
    placed = first.join(posts.select("post", "signature_at"), "post")
    out = placed.groupBy("lens", "code").agg(F.count_if(F.col("start") >= F.col("signature_at")).alias("posts"), F.count("*").alias("of_posts"))
    return out.filter("posts > 0")


def features_by_day(posts: DataFrame, features: DataFrame, k: int = 6) -> DataFrame:
    """Posts per day for each of the k features that most posts have (tie: name)."""
    rows = features.select("post", "feature").distinct().join(posts.select("post", "day"), "post")
    best = rows.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "feature").limit(k)
    return rows.join(best.select("feature"), "feature").groupBy("day", "feature").agg(F.count("*").alias("posts"))


def extremes(cells: DataFrame, k: int) -> DataFrame:
    """Per feature the k largest differences in either direction; those that round to 0.0 are left out."""
    sign = F.when(F.bround("points", 1) > 0, 1).when(F.bround("points", 1) < 0, -1)
    order = Window.partitionBy("feature", "sign").orderBy(F.abs("points").desc(), "item")
    rows = cells.withColumn("sign", sign).filter("sign is not null").withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= k).select("feature", "item", "points", "sign", "place")


def largest_pairs(cells: DataFrame, features: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k largest differences, one for a feature, passing over a feature whose posts to read (those with both, or
    with the item alone where none has both) were taken for the same item before."""
    best = Window.partitionBy("feature").orderBy(F.abs("points").desc(), "item")
    one = cells.filter(F.bround("points", 1) != 0).withColumn("r", F.row_number().over(best)).filter("r = 1")
    having = items.select("post", "item").distinct().join(one.select("feature", "item"), "item")
    marked = having.join(features.select("post", "feature").distinct().withColumn("has", F.lit(True)), ["post", "feature"], "left")
    pool = marked.groupBy("feature", "item").agg(F.bit_xor(F.when(F.col("has"), F.xxhash64("post"))).alias("both"), F.count_if(F.col("has").isNotNull()).alias("n_both"), F.bit_xor(F.when(F.col("has").isNull(), F.xxhash64("post"))).alias("rest"), F.count_if(F.col("has").isNull()).alias("n_rest"))
    print_ = F.when(F.col("n_both") > 0, F.struct(F.col("n_both").alias("n"), F.col("both").alias("h"))).otherwise(F.struct(F.col("n_rest").alias("n"), F.col("rest").alias("h")))
    again = Window.partitionBy("item", "pool").orderBy(F.abs("points").desc(), "feature")
    rows = one.join(pool.select("feature", "item", print_.alias("pool")), ["feature", "item"]).withColumn("again", F.row_number().over(again)).filter("again = 1")
    return rows.orderBy(F.abs("points").desc(), "feature", "item").limit(k).select("feature", "item", "points")


def feature_days(posts: DataFrame, features: DataFrame) -> DataFrame:
    """Per feature: posts, the first and the last day of them, the day with most (tie: earliest) and its posts."""
    days = features.select("post", "feature").distinct().join(posts.select("post", "day"), "post").groupBy("feature", "day").agg(F.count("*").alias("n"))
    peak = F.min(F.struct((-F.col("n")).alias("n"), "day"))
    out = days.groupBy("feature").agg(F.sum("n").alias("posts"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), peak.alias("p"))
    return out.select("feature", "posts", "first_day", "last_day", F.col("p.day").alias("peak_day"), (-F.col("p.n")).alias("peak_posts"))
