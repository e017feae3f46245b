"""Field notes of several notebooks gathered into threads, and rounds of answers on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

THREAD = r"\bt\d{3,}\b"


def _digits(place, least: int = 3):
    text = place.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(least) - F.length(text))), text)


def threads(notes: DataFrame) -> DataFrame:
    """``notes(id, notebook, at, about, body, signed)`` with ``thread``, ``stands``: notes about the same ordered units are one
    thread; of a notebook's notes on it the earliest stands. Threads are numbered by the notebook, time and id of the
    note that first made them."""
    key = F.sha2(F.to_json(F.struct("about")).cast("binary"), 256)
    rows = notes.withColumn("key", key)
    first = rows.groupBy("key").agg(F.min(F.struct("notebook", "at", "id")).alias("made"))
    numbered = ranked(first, [], ["made"]).select("key", F.concat(F.lit("t"), _digits(F.col("_rn") + 1)).alias("thread"))
    mine = Window.partitionBy("key", "notebook").orderBy("at", "id")
    return rows.withColumn("stands", F.row_number().over(mine) == 1).join(numbered, "key").drop("key")


def thread_units(threaded: DataFrame) -> DataFrame:
    """``thread, place, unit``: the statement that a note means by its number, from 1."""
    one = threaded.groupBy("thread").agg(F.first("about").alias("about"))
    return one.select("thread", F.posexplode("about").alias("place", "unit")).select("thread", (F.col("place") + 1).alias("place"), "unit")


def unread_threads(threaded: DataFrame, read: DataFrame) -> DataFrame:
    """``thread, notebook`` without a note there whose notebook has not read all its units. ``read(notebook, unit)``."""
    every = threaded.agg(F.collect_set("notebook").alias("every"))  # notebooks are few: one row
    noted = threaded.groupBy("thread").agg(F.collect_set("notebook").alias("noted"))
    missing = noted.crossJoin(every).select("thread", F.explode(F.array_except("every", "noted")).alias("notebook"))
    wanted = missing.join(thread_units(threaded), "thread")
    return wanted.join(read.select("notebook", "unit").distinct(), ["notebook", "unit"], "left_anti").select("thread", "notebook").distinct()


def board_report(threaded: DataFrame) -> DataFrame:
    """Per notebook: standing notes, their characters, signed ones, threads without a note of it, notes on threads that the
    first notebook does not have, notes set aside."""
    first = threaded.filter(F.col("notebook") == 0).select(F.col("thread").alias("of_first")).distinct()
    total = threaded.select("thread").distinct().agg(F.count("*").alias("threads"))
    rows = threaded.join(first, F.col("thread") == F.col("of_first"), "left")
    out = rows.groupBy("notebook").agg(
        F.count_if("stands").alias("notes"), F.sum(F.when(F.col("stands"), F.length(F.coalesce("body", F.lit("")))).otherwise(0)).alias("characters"),
        F.count_if(F.col("stands") & (F.coalesce("signed", F.lit("")) != "")).alias("signed"), F.count_if(F.col("stands") & F.col("of_first").isNull()).alias("stray"), F.count_if(~F.col("stands")).alias("set_aside"),
    )
    return out.crossJoin(total).select("notebook", "notes", "characters", "signed", (F.col("threads") - F.col("notes")).alias("without_note"), "stray", "set_aside")


def field_notes_by_reader(notes: DataFrame, k: int = 2) -> DataFrame:
    """``notes(id, lens, body, signed)``: per lens its notes, signed ones, distinct signatures, characters, and the ids of its
    k longest notes."""
    base = notes.groupBy("lens").agg(F.count("*").alias("notes"), F.count(F.nullif("signed", F.lit(""))).alias("signed"), F.countDistinct(F.nullif("signed", F.lit(""))).alias("signatures"), F.sum(F.length("body")).alias("characters"))
    order = Window.partitionBy("lens").orderBy(F.length("body").desc(), "id")
    best = notes.select("lens", "id", F.row_number().over(order).alias("r")).filter(F.col("r") <= k).groupBy("lens").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("l"))
    return base.join(best, "lens").select("lens", "notes", "signed", "signatures", "characters", F.array_join(F.transform("l", lambda x: x["id"].cast("string")), ",").alias("longest"))


def note_lenses(notes: DataFrame) -> DataFrame:
    """Lenses that left notes: count, first and last."""
    return notes.groupBy("lens").agg(F.count("*").alias("notes"), F.min("at").alias("first"), F.max("at").alias("last"))


def _by_seat(answers: DataFrame, seats: DataFrame) -> DataFrame:
    """Each round that anybody answered, with each expected seat: its finished answers and the first of them. Seats are few."""
    found = answers.filter("status = 'ok'").groupBy("round", "seat").agg(F.count("*").alias("n"), F.min("activity").alias("activity"))
    every = seats.agg(F.collect_set("seat").alias("every"))
    grid = answers.select("round").distinct().crossJoin(every).select("round", F.explode("every").alias("seat"))
    return grid.join(found, ["round", "seat"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def round_answers(answers: DataFrame, seats: DataFrame) -> DataFrame:
    """``answers(round, seat, activity, status)`` and ``seats(seat)``: per round and seat the one finished answer. A seat with
    none or several is an error; see refused_rounds()."""
    wrong = F.raise_error(F.concat(F.lit("round "), F.col("round").cast("string"), F.lit(", seat "), F.col("seat").cast("string"), F.lit(": not exactly one finished answer")))
    return _by_seat(answers, seats).select("round", "seat", F.when(F.col("n") == 1, F.col("activity")).otherwise(wrong.cast("string")).alias("activity"))


def refused_rounds(answers: DataFrame, seats: DataFrame) -> DataFrame:
    """What round_answers() would give or refuse, as rows: ``round, seat, n, activity, problem``; ``activity`` is there where
    exactly one answer is."""
    one = F.col("n") == 1
    return _by_seat(answers, seats).select("round", "seat", "n", F.when(one, F.col("activity")).alias("activity"), F.when(F.col("n") == 0, "no finished answer").when(~one, "several finished answers").alias("problem"))


def round_status(answers: DataFrame, seats: DataFrame) -> DataFrame:
    """Per round: finished answers, seats expected, and whether each seat answered exactly once."""
    by = answers.filter("status = 'ok'").groupBy("round", "seat").agg(F.count("*").alias("n")).groupBy("round").agg(F.sum("n").alias("answers"), F.count_if(F.col("n") == 1).alias("once"))
    return by.crossJoin(seats.agg(F.count("*").alias("seats"))).select("round", "answers", "seats", ((F.col("answers") == F.col("seats")) & (F.col("once") == F.col("seats"))).alias("complete"))


def shared_threads(messages: DataFrame) -> DataFrame:
    """``messages(kind, thread, seat)``: threads other than the board itself that drew a reply from more than one seat, with
    those seats in order."""
    drew = messages.filter("kind = 'reply' and thread <> 'board'").groupBy("thread").agg(F.sort_array(F.collect_set("seat")).alias("seats"))
    return drew.filter(F.size("seats") > 1)


def board_reading(threaded: DataFrame, read: DataFrame) -> DataFrame:
    """Per notebook: units it has read, and threads without a note of it some of whose units it has not."""
    books = threaded.select("notebook").distinct()
    units = read.select("notebook", "unit").distinct().groupBy("notebook").agg(F.count("*").alias("units_read"))
    rest = unread_threads(threaded, read).groupBy("notebook").agg(F.count("*").alias("threads_not_read"))
    out = books.join(units, "notebook", "left").join(rest, "notebook", "left")
    return out.select("notebook", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("units_read", "threads_not_read")])


def signatures_by_reader(notes: DataFrame) -> DataFrame:
    """``lens, signed, notes``: each signature a lens chose, with its notes; notes that are not signed are left out."""
    return notes.filter(F.coalesce("signed", F.lit("")) != "").groupBy("lens", "signed").agg(F.count("*").alias("notes"))


def later_round_threads(messages: DataFrame, known: DataFrame) -> DataFrame:
    """``messages(kind, thread, body)`` (kinds reply, request, closing) and ``known(thread)``: threads to show next: they drew a
    reply, were asked for, or are named in any message."""
    drew = messages.filter("kind in ('reply', 'request')").select("thread")
    named = messages.select(F.explode(F.regexp_extract_all("body", F.lit(THREAD), F.lit(0))).alias("thread"))
    return known.select("thread").join(drew.unionByName(named).distinct(), "thread", "left_semi")


def silent_seats(answered: DataFrame, messages: DataFrame) -> DataFrame:
    """``round, seat`` that answered and said nothing at all."""
    return answered.select("round", "seat").distinct().join(messages.select("round", "seat").distinct(), ["round", "seat"], "left_anti")
