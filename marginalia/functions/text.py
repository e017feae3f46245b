"""Column functions over text: white space, lines of a page, signatures, matches with positions, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space (Java regex class).
PYWS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: What ends a signed line, and what opens a heading, a link line or a list line.
SIGNATURE = rf"--{PYWS}*([A-Za-z][A-Za-z0-9_]{{2,47}}){PYWS}*(\?)?{PYWS}*\z"
HEADING = r"(?s)^=+.*=+\z"
LINK_START = rf"^(?:[*#:]+{PYWS}*)?\[?https?://|^\[\[[^\]]*\]\]\z"
LISTISH = rf"^(?:[*#:]+{PYWS}*)?\[?https?://|^[*#]+{PYWS}|^\{{?\||^\[\[[^\]]*\]\]\z"
LINE_BLANKS = " \t\r\x0b\x0c"

#: Fixed value: a ledger time whose day is known.
TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z\z"


def collapse_ws(text: Column) -> Column:
    """White-space runs made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, PYWS + "+", " "))


def name_key(name: Column) -> Column:
    """How names are compared: collapsed and lower-cased."""
    return F.lower(collapse_ws(name))


#: Names suggested by readers are compared alike; letters whose full case folding differs from lower case stay apart.
fold = name_key


def classify_line(line: Column) -> Column:
    """``heading``, ``signed``, ``list`` or ``plain``; a signed line that opens with a link stays a list line."""
    return (
        F.when(line.rlike(HEADING), "heading")
        .when(line.rlike(SIGNATURE) & ~line.rlike(LINK_START), "signed")
        .when(line.rlike(LISTISH), "list")
        .otherwise("plain")
    )


def signature_of(line: Column) -> Column:
    """The name after ``--`` at the end of a line, or null."""
    return F.nullif(F.regexp_extract(line, SIGNATURE, 1), F.lit(""))


def signature_uncertain(line: Column) -> Column:
    """Whether a question mark follows the name."""
    return F.regexp_extract(line, SIGNATURE, 2) != ""


def quoted(text: Column) -> Column:
    """A regular expression that matches the text itself, whatever it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def strip_signature(text: Column, signature: Column) -> Column:
    """A post without its closing ``-- Name ?``."""
    tail = F.concat(F.lit(f"--{PYWS}*"), quoted(signature), F.lit(rf"{PYWS}*\??{PYWS}*\z"))
    return F.when(signature.isNull(), text).otherwise(F.regexp_replace(text, tail, F.lit("")))


def body_of(text: Column, signature: Column) -> Column:
    """A looser cut: the signature at the very end goes, then blanks and dashes."""
    cut = F.when(F.endswith(text, signature), F.left(text, F.length(text) - F.length(signature))).otherwise(text)
    return F.when(signature.isNull(), text).otherwise(F.rtrim(cut, F.lit(" -")))


def day_of(time: Column) -> Column:
    """UTC date of a well-formed time, else ``unknown day``."""
    return F.when(time.rlike(TIME), F.substring(time, 1, 10)).otherwise("unknown day")


def find_matches(text: Column, pattern: str | Column) -> Column:
    """All matches in order: array of ``start, end`` (code points) ``, said``. The text between matches comes from a
    split by the same pattern, so positions are running lengths."""
    kind = "array<struct<start:int,end:int,said:string>>"
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.zip_with(F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("said")))
    pairs = F.filter(pairs, lambda p: p["said"].isNotNull())

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["said"])
        one = F.struct(start.alias("start"), end.alias("end"), p["said"].alias("said"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def snippet(text: Column, start: Column, end: Column, width: int) -> Column:
    """The match with ``width`` characters on either side, white space collapsed, dots where text was cut."""
    low, high = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    body = collapse_ws(F.substring(text, low + 1, high - low))
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(text), "…").otherwise(""))


def snippet_words(text: Column, start: Column, end: Column, width: int = 160) -> Column:
    """About ``width`` characters around a match, cut between words and never inside the match, blanks at the ends off."""
    start, end = start.cast("int"), end.cast("int")
    size, pad = F.length(text), F.greatest(F.lit(0), F.lit(width) - (end - start))
    low = F.greatest(F.lit(0), start - F.floor(pad / 2).cast("int"))
    high = F.least(size, end + pad - (start - low))
    low = F.greatest(F.lit(0), start - (pad - (high - end)))
    blank = lambda at: F.substring(text, at, F.lit(1)).rlike(PYWS)
    word = r"(?:(?!" + PYWS + r").)"
    left, right = F.substring(text, low + 1, start - low), F.substring(text, end + 1, high - end)
    left = F.when((low > 0) & ~blank(low), F.regexp_replace(left, rf"(?s)^{word}*", "")).otherwise(left)
    right = F.when((high < size) & ~blank(high + 1), F.regexp_replace(right, rf"(?s){word}*\z", "")).otherwise(right)
    match = F.substring(text, start + 1, end - start)
    return F.concat(F.regexp_replace(left, rf"^{PYWS}+", ""), match, F.regexp_replace(right, rf"{PYWS}+\z", ""))


def clip(text: Column, start: Column, end: Column, size: int) -> Column:
    """About ``size`` characters around the middle of the match."""
    middle = F.floor((start + end) / 2).cast("int") - size // 2
    low = F.greatest(F.lit(0), F.least(middle, F.length(text) - size))
    cut = F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, F.lit(size)), F.when(low + size < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= size, text).otherwise(cut)


def byte_at(text: Column, chars: Column) -> Column:
    """UTF-8 byte offset of a character offset."""
    return F.octet_length(F.left(text, chars)).cast("long")
