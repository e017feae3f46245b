"""Tracing terms through statements: hits, counts by term and day, first uses, spread, concordance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, find_matches
from ..sources.terms import BETWEEN, EDGE_LEFT, EDGE_RIGHT
from .anchors import term_anchor
from .ranks import ranked

#: Terms that one job searches for at most; a term list is written by hand.
MAX_TERMS = 10_000


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _term_rows(terms: DataFrame) -> list:
    """A hand-written list, checked for its size, becomes literal patterns that are compiled once a task."""
    rows = terms.select("term", "pattern").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return rows


#: A pattern as sources.terms writes it for words; its first word has no other letter or digit on either side.
_PLAIN = re.compile(rf"(\(\?iu\))?{re.escape(EDGE_LEFT)}([A-Za-z0-9]+)((?:[A-Za-z0-9_]|\\[^A-Za-z0-9]|{re.escape(BETWEEN)})*){re.escape(EDGE_RIGHT)}")
#: Letters that are one with an ASCII letter when case is ignored.
_ALIKE = ("ſıİK", "siik")


def trie_pattern(words: set[str]) -> str:
    """A pattern for any of the words that looks at each letter once, however many words there are."""
    by_first: dict[str, set[str]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], set()).add(w[1:])
    arms = [first + trie_pattern(rest) for first, rest in sorted(by_first.items())]
    body = arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"
    return (f"(?:{body})?" if "" in words else body) if arms else ""


def _anchored(rows: list) -> tuple[dict[str, dict[str, list]], list]:
    """Terms by flag and first word, each with its pattern, or None where the word is all; and terms without such a word."""
    anchors: dict[str, dict[str, list]] = {"": {}, "(?iu)": {}}
    loose = []
    for r in rows:
        plain = _PLAIN.fullmatch(r.pattern)
        if not plain:
            loose.append(r)
            continue
        flag, word, more = plain[1] or "", plain[2], plain[3]
        anchors[flag].setdefault(word.lower() if flag else word, []).append((r.term, r.pattern if more else None))
    return anchors, loose


def term_hits(units: DataFrame, terms: DataFrame) -> DataFrame:
    """``units(unit, text, ...)`` to one row for each unit and term found in it: all columns but text, ``term, n``.

    The first words of all terms are one pattern, for which a text is searched once. Terms of one word are counted from what that
    finds; the pattern of a longer one is only searched for in texts that hold its first word. Given patterns are searched for in
    every text. There is no join and no shuffle."""
    others = [c for c in units.columns if c != "text"]
    rows = _term_rows(terms)
    if not rows:
        return units.select(*others, F.lit("").alias("term"), F.lit(0).alias("n")).limit(0)
    anchors, loose = _anchored(rows)
    anchors = {flag: words for flag, words in anchors.items() if words}
    found = {}
    for i, (flag, words) in enumerate(anchors.items()):
        said = F.regexp_extract_all("text", F.lit(f"{flag}{EDGE_LEFT}{trie_pattern(set(words))}{EDGE_RIGHT}"), F.lit(0))
        found[f"_said{i}"] = F.transform(said, lambda m: F.lower(F.translate(m, *_ALIKE))) if flag else said
    texts = units.select(*others, "text", *[c.alias(name) for name, c in found.items()])
    hits = [_counted(F.col(name), words) for name, words in zip(found, anchors.values(), strict=True)]
    if loose:
        hits.append(F.array(*[F.struct(F.lit(r.term).alias("term"), F.regexp_count("text", F.lit(r.pattern)).alias("n")) for r in loose]))
    out = texts.select(*others, F.explode(F.filter(F.concat(*hits), lambda f: f["n"] > 0)).alias("f"))
    return out.select(*others, "f.term", "f.n")


def _counted(said: Column, words: dict[str, list]) -> Column:
    """From the first words found in a text, as often as they are there: the terms that begin so, with their numbers."""
    term = lambda t: F.struct(F.lit(t[0]).alias("term"), F.lit(t[1]).cast("string").alias("pattern"))
    table = F.create_map(*[x for w, found in words.items() for x in (F.lit(w), F.array(*map(term, found)))])

    def one(word: Column) -> Column:
        uses = F.size(F.filter(said, lambda x: x == word))
        return F.transform(F.try_element_at(table, word), lambda t: F.struct(t["term"].alias("term"), F.when(t["pattern"].isNull(), uses).otherwise(F.regexp_count("text", t["pattern"])).alias("n")))

    return F.coalesce(F.flatten(F.transform(F.array_distinct(said), one)), F.array().cast("array<struct<term:string,n:int>>"))


def trace_terms(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Per term: units, occurrences, distinct signers (nulls out), pages, first and last use, busiest day and its count
    (tie: earliest), units later removed. Terms found nowhere have zeros. ``hits`` carries ``term, unit, n, time,
    signer, page, removed``; it is read once, and counted by term, and by term with day, signer or page."""
    rows = hits.select("term", "unit", "n", "time", "signer", "page", "removed", _day(F.col("time")).alias("day"))
    sets = [[F.col("term")], *([F.col("term"), F.col(c)] for c in ("day", "signer", "page"))]
    parts = rows.groupingSets(sets, "term", "day", "signer", "page").agg(
        F.count("unit").alias("units"), F.sum("n").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.count_if("removed").alias("removed"),
        *[F.grouping(c).alias(f"no_{c}") for c in ("day", "signer", "page")],
    )
    by = {c: F.col(f"no_{c}") == 0 for c in ("day", "signer", "page")}
    whole = ~(by["day"] | by["signer"] | by["page"])
    peak = F.min(F.when(by["day"], F.struct((-F.col("units")).alias("n"), F.col("day"))))
    one = lambda c: F.max(F.when(whole, F.col(c)))
    counts = parts.groupBy("term").agg(
        one("units").alias("units"), one("n").alias("occurrences"), F.count_if(by["signer"] & F.col("signer").isNotNull()).alias("signers"), F.count_if(by["page"] & F.col("page").isNotNull()).alias("pages"),
        one("first").alias("first_use"), one("last").alias("last_use"), one("removed").alias("later_removed"), peak.alias("peak"),
    )
    counts = counts.select("*", F.col("peak.day").alias("peak_day"), (-F.col("peak.n")).alias("peak_units")).drop("peak")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("units", "occurrences", "signers", "pages", "later_removed", "peak_units")}
    return terms.select("term").join(counts, "term", "left").withColumns(zero)


def _day(time: Column) -> Column:
    return F.substring(F.coalesce(time, F.lit("")), 1, 10)


def term_by_day(hits: DataFrame) -> DataFrame:
    """Units per term per day; the day of an undated unit is empty."""
    return hits.groupBy("term", _day(F.col("time")).alias("day")).agg(F.count("unit").alias("units"))


def busiest_day(by_day: DataFrame) -> DataFrame:
    order = Window.partitionBy("term").orderBy(F.col("units").desc(), "day")
    return by_day.withColumn("r", F.row_number().over(order)).filter("r = 1").select("term", F.col("day").alias("peak_day"), F.col("units").alias("peak_units"))


def absent_terms(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """Terms searched for and found nowhere."""
    return terms.select("term").join(hits.select("term").distinct(), "term", "left_anti")


def first_use(hits: DataFrame) -> DataFrame:
    """The first hit of each term by time, then unit; undated units come first."""
    order = Window.partitionBy("term").orderBy(F.coalesce("time", F.lit("")), "unit")
    return hits.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def first_use_anchors(hits: DataFrame, units: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, unit, time, n, start, end, exact``: the first hit of each term with the span of its first match in the source.
    ``units(unit, start, text)``. Only the texts of first hits are searched again, each by its own term's pattern."""
    first = first_use(hits).select("term", "unit", "time", "n").join(terms.select("term", "pattern"), "term")
    placed = term_anchor(first.join(units.select("unit", "start", "text"), "unit"), F.col("pattern"))
    return placed.select("term", "unit", "time", "n", "start", "end", "exact")


def day_axis(days: DataFrame) -> DataFrame:
    """Every day from the first to the last of column ``day``, so that time is to scale."""
    ends = days.agg(F.min(F.col("day").cast("date")).alias("a"), F.max(F.col("day").cast("date")).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d")).select(F.col("d").cast("string").alias("day"))


def adoption(hits: DataFrame, posts: DataFrame, hours: tuple[int, ...] = (1, 3, 6, 24, 48)) -> DataFrame:
    """Per term and number of hours: signers who had taken the term up by then, and signers who posted at all since its
    first use. ``hits(term, signer, ts)``, ``posts(signer, ts)`` with timestamps."""
    took = hits.groupBy("term", "signer").agg(F.min("ts").alias("took"))
    first = took.groupBy("term").agg(F.min("took").alias("first"))
    gap = (micros("took") - micros("first")) / 3.6e9
    axis = F.explode(F.array(*map(F.lit, hours))).alias("hours")
    rows = took.join(first, "term").select("term", gap.alias("gap"), axis)
    adopters = rows.groupBy("term", "hours").agg(F.count_if(F.col("gap") <= F.col("hours")).alias("adopters"))
    # the longest span only is joined, by the days it touches; shorter ones are counted inside it
    days = F.sequence(F.to_date("first"), F.to_date(F.timestamp_micros(micros("first") + max(hours) * 3_600_000_000)))
    spans = first.select("term", "first", F.explode(days).alias("day"))
    inside = (F.col("ts") >= F.col("first")) & (micros("ts") <= micros("first") + max(hours) * 3_600_000_000)
    near = posts.withColumn("day", F.to_date("ts")).join(spans, "day").filter(inside)
    near = near.groupBy("term", "signer").agg(F.min((micros("ts") - micros("first")) / 3.6e9).alias("gap"))
    posting = near.select("term", "gap", axis).groupBy("term", "hours").agg(F.count_if(F.col("gap") <= F.col("hours")).alias("posting"))
    return adopters.join(posting, ["term", "hours"], "left").select("term", "hours", "adopters", F.coalesce("posting", F.lit(0)).cast("long").alias("posting"))


def adoption_steps(hits: DataFrame) -> DataFrame:
    """Number of adopters after each hour since first use, listed where it changes."""
    took = hits.groupBy("term", "signer").agg(F.min("ts").alias("took"))
    first = took.groupBy("term").agg(F.min("took").alias("first"))
    hour = F.ceil((micros("took") - micros("first")) / 3.6e9).cast("long")
    by_hour = took.join(first, "term").groupBy("term", hour.alias("hour")).agg(F.count("*").alias("new"))
    return by_hour.select("term", "hour", F.sum("new").over(Window.partitionBy("term").orderBy("hour")).alias("adopters"))


def first_adopters(hits: DataFrame, k: int = 5) -> DataFrame:
    took = hits.groupBy("term", "signer").agg(F.min("ts").alias("took"))
    return top(took, ["term"], ["took", "signer"], k)


def top(rows: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1 as ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def concordance(units: DataFrame, pattern: str, width: int = 60) -> DataFrame:
    """Every use of a pattern with the text on either side, numbered in order of time, unit and position: ``n, use, left,
    said, right`` and the unit's other columns. Texts are searched once."""
    others = [c for c in units.columns if c != "text"]
    rows = units.select(*others, "text", F.posexplode(find_matches(F.col("text"), pattern)).alias("i", "m"))
    low = F.greatest(F.col("m.start") - width, F.lit(0))
    left = collapse_ws(F.substring(F.col("text"), low + 1, F.col("m.start") - low))
    right = collapse_ws(F.substring(F.col("text"), F.col("m.end") + 1, F.lit(width)))
    found = rows.select(*others, F.col("i").alias("use"), left.alias("left"), F.col("m.said").alias("said"), right.alias("right"))
    time = F.coalesce("time", F.lit(""))
    return ranked(found, [], [time, F.col("unit"), F.col("use")]).withColumn("n", F.col("_rn") + 1).drop("_rn", "_n")


def thin(rows: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """At most k rows of each group, evenly spaced with the first and last kept; positions are rounded half to even."""
    placed = ranked(rows, by, order)
    # row r is shown when some i in 0..k-1 has round(i * (n-1) / (k-1)) = r
    step = (F.col("_n") - 1) / F.lit(max(k - 1, 1))
    i = F.round(F.col("_rn") / step).cast("int")
    near = F.array(i - 1, i, i + 1)
    hit = F.exists(near, lambda x: (x >= 0) & (x <= k - 1) & (F.bround(x * (F.col("_n") - 1) / F.lit(max(k - 1, 1))).cast("int") == F.col("_rn")))
    return placed.filter((F.col("_n") <= k) | hit).drop("_rn", "_n")


def spread_examples(rows: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """At most k rows of each group, evenly spaced by integer position from the first to the last."""
    placed = ranked(rows, by, order)
    # floor(i * (n-1) / (k-1)) = r for i = ceil(r * (k-1) / (n-1))
    gap = F.greatest(F.col("_n") - 1, F.lit(1))
    i = F.ceil(F.col("_rn") * (k - 1) / gap)
    hit = (i <= k - 1) & (F.floor(i * gap / F.lit(max(k - 1, 1))) == F.col("_rn"))
    return placed.filter((F.col("_n") <= k) | hit).drop("_rn", "_n") if k > 1 else placed.filter(F.col("_rn") < k).drop("_rn", "_n")


def fastest_spread(spread: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The k terms that most signers took up within an hour (then three, then earlier first use, then name), with
    ``tied`` where the next term has the same counts. Terms are few; this is one small sort."""
    wide = spread.groupBy("term").agg(*[F.max(F.when(F.col("hours") == h, F.col("adopters"))).alias(f"h{h}") for h in (1, 3)])
    order = [F.col("h1").desc(), F.col("h3").desc(), F.col("first_use"), F.col("term")]
    ranked = wide.join(first, "term").orderBy(*order).limit(k + 1)
    w = Window.orderBy(*order)
    ranked = ranked.withColumn("place", F.row_number().over(w)).withColumn("tied", (F.lead("h1").over(w) == F.col("h1")) & (F.lead("h3").over(w) == F.col("h3")))
    return ranked.filter(F.col("place") <= k).select("place", "term", "h1", "h3", "first_use", F.coalesce("tied", F.lit(False)).alias("tied"))


def words_around(units: DataFrame, pattern: str, k: int = 5, width: int = 28) -> DataFrame:
    """The k most frequent contexts of a pattern: white space collapsed, lower case; ties by the context."""
    rows = units.select("text", F.explode(find_matches(F.col("text"), pattern)).alias("m"))
    low = F.greatest(F.col("m.start") - width, F.lit(0))
    around = F.lower(collapse_ws(F.substring(F.col("text"), low + 1, F.col("m.end") + width - low)))
    return rows.groupBy(around.alias("context")).agg(F.count("*").alias("uses")).orderBy(F.col("uses").desc(), "context").limit(k)


def probe_words(units: DataFrame, words: list[str], kind: Column) -> DataFrame:
    """Per probe word and kind of unit: units and occurrences as a whole word, in any case."""
    found = F.array(*[F.struct(F.lit(w).alias("word"), F.regexp_count("text", F.lit(rf"(?iu)(?<![A-Za-z0-9])\Q{w}\E(?![A-Za-z0-9])")).alias("n")) for w in words])
    rows = units.select(kind.alias("kind"), F.explode(found).alias("f")).select("kind", "f.*")
    return rows.groupBy("word", "kind").agg(F.count_if(F.col("n") > 0).alias("units"), F.sum("n").alias("occurrences"))


def longer_words(units: DataFrame, stem: str, k: int = 8) -> DataFrame:
    """The k most frequent words that hold a stem and more, lower-cased."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[a-z]*\Q{stem.lower()}\E[a-z]*"), F.lit(0))
    rows = units.select(F.explode(words).alias("word")).filter(F.col("word") != stem.lower())
    return rows.groupBy("word").agg(F.count("*").alias("uses")).orderBy(F.col("uses").desc(), "word").limit(k)


def loose_words(units: DataFrame, stem: str, k: int = 8) -> DataFrame:
    """``word, uses``: the k most frequent words that hold a stem in any case, as written in ``text``; a word of the unit's
    ``names`` counts once a unit and is marked as such. Ties by the word."""
    pattern = F.lit(rf"(?i)[A-Za-z]*\Q{stem}\E[A-Za-z]*")
    said = F.regexp_extract_all(F.coalesce("text", F.lit("")), pattern, F.lit(0))
    named = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("names", F.lit("")), pattern, F.lit(0))), lambda w: F.concat(w, F.lit(" (in a name)")))
    rows = units.select(F.explode(F.concat(said, named)).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("uses")).orderBy(F.col("uses").desc(), "word").limit(k)
