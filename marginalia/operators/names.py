"""How names are built, when they appear, who signs as whom, who is spoken to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import DATE_CODE, date_codes, date_of, kinds_of, name_features, name_parts

#: Words of the first person, clock words beside a date code.
SINGULAR = r"(?<![A-Za-z])(I|[Mm]y|[Mm]e)(?![A-Za-z])"
PLURAL = r"(?<![A-Za-z])([Ww]e|[Oo]ur|[Uu]s)(?![A-Za-z])"
TOKEN = r"[A-Za-z0-9_]+"
#: Characters in a run by which names without a letter or digit are looked up.
GRAM = 3


def first_saved(saves: DataFrame) -> DataFrame:
    """``saves(label, time, derived)`` to each name's first save and number of saves; derived sources do not count."""
    return saves.filter("label is not null and label <> '' and not coalesce(derived, false)").groupBy("label").agg(F.min(F.coalesce("time", F.lit(""))).alias("first_time"), F.count("*").alias("saves"))


def names_by_day(saves: DataFrame) -> DataFrame:
    """A name counts on the day it first saves: names, and how many carry a part of each kind."""
    rows = first_saved(saves).select(F.substring("first_time", 1, 10).alias("day"), kinds_of(F.col("label")).alias("kinds"))
    kinds = [F.count_if(F.array_contains("kinds", k)).alias(f"{k}_names") for k in ("institution", "role", "date", "collective")]
    return rows.groupBy("day").agg(F.count("*").alias("names"), *kinds)


def name_parts_usage(saves: DataFrame) -> DataFrame:
    """Per part of two characters or more, not a number: how many names use it, the first of them and its time."""
    parts = F.explode(F.array_distinct(name_parts(F.col("label")))).alias("part")
    rows = first_saved(saves).select("label", "first_time", parts).filter(F.col("part").rlike(r"\D") & (F.length("part") > 1))
    first = F.min(F.struct("first_time", "label"))
    return rows.groupBy("part").agg(F.count("*").alias("names"), first.alias("f")).select("part", "names", F.col("f.label").alias("first_name"), F.col("f.first_time").alias("first_time"))


def signed_as_another(posts: DataFrame) -> DataFrame:
    """``posts(signature, saved)``: posts signed by another name than they were saved under, and those of them whose
    two names carry the same date."""
    other = posts.filter("saved is not null and signature is not null and signature <> saved")
    same = date_of(F.col("signature")) == date_of(F.col("saved"))
    return other.agg(F.count("*").alias("differs"), F.count_if(same).alias("same_date"))


def mentions(posts: DataFrame, names: DataFrame, least: int = 8) -> DataFrame:
    """``posts(post, body, signature)`` and ``names(name)`` to distinct ``post, name`` where the body uses a known name of
    ``least`` or more characters that is not the post's own signature. Names of letters, digits and underscores are
    whole tokens, so this is a join on tokens. A name with other characters joins on its longest token, one without any token
    on the one of its short runs of characters that fewest posts hold; posts that hold one are searched for all their
    names at once, the longest first, so that no name counts inside a longer one."""
    known = names.filter(F.length("name") >= least).select("name").distinct()
    plain = F.col("name").rlike(rf"^{TOKEN}\z")
    tokens = F.array_distinct(F.regexp_extract_all("body", F.lit(TOKEN), F.lit(0)))
    words = posts.select("post", F.explode(tokens).alias("token"))
    found = words.filter(F.length("token") >= least).join(known.filter(plain), F.col("token") == F.col("name")).select("post", "name")
    odd = known.filter(~plain)
    if not odd.isEmpty():
        own = F.regexp_extract_all("name", F.lit(TOKEN), F.lit(0))
        anchor = F.aggregate(own, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
        odd = odd.withColumn("anchor", anchor)
        near = words.join(odd.filter("anchor <> ''"), F.col("token") == F.col("anchor")).select("post", "name")
        bare = odd.filter("anchor = ''").select("name")
        if not bare.isEmpty():
            near = near.unionByName(_by_rarest_gram(posts, bare, min(GRAM, least)))
        near = near.join(posts.select("post", "body"), "post").filter(F.contains("body", "name")).select("post", "name")
        asked = near.select("post").distinct()
        several = found.join(asked, "post", "left_semi").unionByName(near).groupBy("post").agg(F.collect_set("name").alias("names"))
        said = F.pandas_udf(_said, "array<string>")
        searched = posts.join(several, "post").select("post", F.explode(said("body", "names")).alias("name"))
        found = found.join(asked, "post", "left_anti").unionByName(searched)
    return found.join(posts.select("post", "signature"), "post").filter(~F.col("name").eqNullSafe(F.col("signature"))).select("post", "name")


def _grams(text: str, n: int) -> Column:
    """Distinct runs of n characters, none of them a letter, digit or underscore."""
    long = F.regexp_extract_all(text, F.lit(rf"[^A-Za-z0-9_]{{{n},}}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(long, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n)))))


def _by_rarest_gram(posts: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """``post, name``: posts that hold the gram of a name without tokens that is in fewest posts."""
    held = posts.select("post", F.explode(_grams("body", n)).alias("gram"))
    wanted = names.select("name", F.explode(_grams("name", n)).alias("gram"))
    held = held.join(wanted.select("gram").distinct(), "gram", "left_semi")
    spread = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(spread, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0")
    return held.join(rarest.select("name", F.col("m.gram").alias("of")), F.col("gram") == F.col("of")).select("post", "name")


def _said(bodies: pd.Series, names: pd.Series) -> pd.Series:
    def one(body: str, some: list[str]) -> list[str]:
        longest = "|".join(sorted(map(re.escape, some), key=len, reverse=True))
        return list(dict.fromkeys(re.findall(rf"(?<![A-Za-z0-9_])(?:{longest})(?![A-Za-z0-9_])", body)))

    return pd.Series([one(b, list(n)) for b, n in zip(bodies, names, strict=True)])


def dated_posts(posts: DataFrame) -> DataFrame:
    """Distinct ``post, code``: month-and-day codes in bodies other than the signature's own."""
    codes = F.filter(date_codes(F.col("body")), lambda c: c.isNotNull())
    rows = posts.filter(F.col("body").rlike(DATE_CODE)).select("post", date_of(F.col("signature")).alias("own"), F.explode(codes).alias("code"))
    return rows.filter(~F.col("code").eqNullSafe(F.col("own"))).select("post", "code")


def addressing(posts: DataFrame, names: DataFrame) -> DataFrame:
    """How often each name and each date code is addressed: ``kind`` (name, date), ``said``, ``posts``."""
    by_name = mentions(posts, names).groupBy("name").agg(F.count("*").alias("posts")).select(F.lit("name").alias("kind"), F.col("name").alias("said"), "posts")
    by_code = dated_posts(posts).groupBy("code").agg(F.count("*").alias("posts")).select(F.lit("date").alias("kind"), F.col("code").alias("said"), "posts")
    return by_name.unionByName(by_code)


def savers(posts: DataFrame, top: int = 10) -> DataFrame:
    """One row: names that save lines signed by others, those with five or more signatures, those with one, posts, and
    the share of posts of the ``top`` most various."""
    other = posts.filter("saved is not null and signature is not null and signature <> saved")
    by = other.groupBy("saved").agg(F.count("*").alias("posts"), F.countDistinct("signature").alias("signatures"))
    total = by.agg(F.count("*").alias("savers"), F.count_if(F.col("signatures") >= 5).alias("five_or_more"), F.count_if(F.col("signatures") == 1).alias("exactly_one"), F.sum("posts").alias("posts"))
    first = by.orderBy(F.col("signatures").desc(), F.col("posts").desc(), "saved").limit(top).agg(F.sum("posts").alias("top_posts"))
    return total.crossJoin(first).select("savers", "five_or_more", "exactly_one", F.coalesce("posts", F.lit(0)).alias("posts"), (F.col("top_posts") / F.col("posts")).alias("top_share"))


def voice_by_day(posts: DataFrame) -> DataFrame:
    """Posts per day with words of the singular, of the plural, with both; a row of day ``all`` for the total."""
    one, many = F.col("body").rlike(SINGULAR), F.col("body").rlike(PLURAL)
    rows = posts.select(F.substring(F.coalesce("time", F.lit("")), 1, 10).alias("day"), one.alias("one"), many.alias("many"))
    out = rows.rollup("day").agg(F.grouping("day").alias("total"), F.count("*").alias("posts"), F.count_if("one").alias("singular"), F.count_if("many").alias("plural"), F.count_if(F.col("one") & F.col("many")).alias("both"))
    return out.select(F.when(F.col("total") == 1, "all").otherwise(F.col("day")).alias("day"), "posts", "singular", "plural", "both")


def date_beside_clock(posts: DataFrame, clock: str) -> DataFrame:
    """One row: posts with a date code within 12 characters of a clock word, and whether one is the signature's own date,
    all are others, or the signature has none. ``clock`` is a regular expression."""
    before = F.regexp_extract_all("body", F.lit(rf"{DATE_CODE}[^A-Za-z0-9]{{0,12}}(?:{clock})"), F.lit(0))
    after = F.regexp_extract_all("body", F.lit(rf"(?:{clock})[^A-Za-z0-9]{{0,12}}{DATE_CODE}"), F.lit(0))
    codes = F.flatten(F.transform(F.concat(before, after), lambda s: date_codes(s)))
    rows = posts.select(date_of(F.col("signature")).alias("own"), codes.alias("codes")).filter(F.size("codes") > 0)
    own = F.array_contains("codes", F.coalesce("own", F.lit("")))
    return rows.agg(F.count("*").alias("posts"), F.count_if(own).alias("same"), F.count_if(~own & F.col("own").isNotNull()).alias("different"), F.count_if(F.col("own").isNull()).alias("undated"))


def signature_features(posts: DataFrame) -> DataFrame:
    """One row: posts, and how many signatures carry a date, role, institution, or differ from the saved name."""
    kinds = kinds_of(F.col("signature"))
    rows = posts.filter("signature is not null").select(kinds.alias("kinds"), (F.col("signature") != F.col("saved")).alias("differs"))
    return rows.agg(F.count("*").alias("posts"), *[F.count_if(F.array_contains("kinds", k)).alias(f"with_{k}") for k in ("date", "role", "institution")], F.count_if("differs").alias("differs"))


def edits_by_day(saves: DataFrame) -> DataFrame:
    """Saves per day and how many carry a date in the name."""
    day = F.substring(F.coalesce("time", F.lit("")), 1, 10)
    return saves.groupBy(day.alias("day")).agg(F.count("*").alias("saves"), F.count_if(date_of(F.col("label")).isNotNull()).alias("dated"))


def busiest_names(saves: DataFrame, k: int = 40) -> DataFrame:
    """The names first saved on the day with most new names (tie: earliest day), in order, k at most."""
    first = first_saved(saves).select("label", "first_time", F.substring("first_time", 1, 10).alias("day"))
    day = first.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "day").limit(1)
    return first.join(F.broadcast(day), "day").orderBy("first_time", "label").limit(k).select("day", "label", "first_time", "n")


def top_parts(saves: DataFrame, k: int = 70) -> DataFrame:
    return name_parts_usage(saves).orderBy(F.col("names").desc(), "part").limit(k)


def signature_parts(posts: DataFrame, k: int = 3) -> DataFrame:
    """``kind, part, posts, place``: the k parts of each kind (role, institution, date) that most signatures carry; ties by
    the part."""
    kinds = F.filter(name_features(F.col("signature")), lambda x: x.rlike("^(role|institution):"))
    dated = F.array_compact(F.array(F.concat(F.lit("date:"), date_of(F.col("signature")))))
    rows = posts.filter("signature is not null").select(F.explode(F.concat(kinds, dated)).alias("x"))
    counts = rows.groupBy(F.split_part("x", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("x", F.lit(":"), F.lit(2)).alias("part")).agg(F.count("*").alias("posts"))
    order = Window.partitionBy("kind").orderBy(F.col("posts").desc(), "part")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
