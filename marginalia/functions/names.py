"""Column functions over names: parts, kinds, dates carried in a name, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a name splits, months and number words inside names, words of each kind, date codes in prose.
PART = r"OpenAI|[A-Z][a-z]+|[A-Z]{2,}(?![a-z])|[a-z]+|\d+"
MONTHS = (
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec January February March April June July August September October "
    "November December Sept Janu Febr Marc Apri Augu Octo Nove Dece"
).split()
NUMBER_WORDS = (
    "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen "
    "Nineteen Twenty"
).split()
NUMBERS = {word: n for n, word in enumerate(NUMBER_WORDS, 1)} | {"Thirty": 30}
KINDS = {
    "institution": "OpenAI OAI".split(),
    "role": (
        "Agent Researcher Research Helper Scout Watcher Coord Runner Relay Reader Observer Monitor Prep Bot User Visitor "
        "Guest Assistant Probe Tester Poller Bridge Beacon Mapper Wrapper Capture Archive Library Link Map"
    ).split(),
    "collective": "Our Team Group Cohort Parallel Collab Shared".split(),
}
DATE_CODE = rf"(?<![A-Za-z])({'|'.join(MONTHS[:12])})[a-z]*\s?(\d{{1,2}})(?!\d)"


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def name_parts(name: Column) -> Column:
    """A name split at its capitals and digits."""
    return F.regexp_extract_all(name, F.lit(PART), F.lit(0))


def date_of(name: Column) -> Column:
    """Month and day inside a name, such as ``Aug8``, or null: the first month part followed by a day in digits, by a
    day run into a stamp of 12 digits or more, or by a day as a word."""
    parts = name_parts(name)
    pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    number = F.create_map(*[x for word, n in NUMBERS.items() for x in (F.lit(word), F.lit(n))])

    def day(b: Column) -> Column:
        digits = b.rlike(r"^\d+\z")
        plain = F.when(F.length(b) <= 9, b.cast("int"))  # longer ones are no day
        plain = F.coalesce(plain, F.when(F.regexp_replace(b, "^0+", "").rlike(r"^\d{1,9}\z"), F.regexp_replace(b, "^0+", "").cast("int")))
        stamp = F.when(F.length(b) >= 12, F.substring(b, 1, 2).cast("int"))
        return F.when(digits & plain.between(1, 31), plain).when(digits & stamp.between(1, 31), stamp).when(~digits, F.try_element_at(number, b))

    def code(p: Column) -> Column:
        return F.concat(F.substring(p["a"], 1, 3), day(p["b"]).cast("string"))

    found = F.transform(F.filter(pairs, lambda p: F.array_contains(_words(MONTHS), p["a"])), code)
    return F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))


def kinds_of(name: Column) -> Column:
    """Which kinds of word a name carries, in the order institution, role, collective, date."""
    parts = name_parts(name)
    kinds = [F.when(F.arrays_overlap(parts, _words(words)), kind) for kind, words in KINDS.items()]
    return F.array_compact(F.array(*kinds, F.when(date_of(name).isNotNull(), "date")))


def name_features(name: Column, extra_parts: tuple[str, ...] = ()) -> Column:
    """Keys of a name's features: ``role``, ``role:Scout``, ``date``, ``part:X`` for parts asked for."""
    parts = F.array_distinct(name_parts(name))
    groups = []
    for kind, words in KINDS.items():
        own = F.array_intersect(parts, _words(words))
        groups.append(F.when(F.size(own) > 0, F.concat(F.array(F.lit(kind)), _prefixed(own, f"{kind}:"))).otherwise(F.array().cast("array<string>")))
    groups.append(F.when(date_of(name).isNotNull(), F.array(F.lit("date"))).otherwise(F.array().cast("array<string>")))
    if extra_parts:
        groups.append(_prefixed(F.array_intersect(parts, _words(list(extra_parts))), "part:"))
    return F.concat(*groups)


def _prefixed(words: Column, prefix: str) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(prefix), w))


def date_codes(text: Column) -> Column:
    """Distinct month-and-day codes in prose, as ``Aug8``, in order of first use."""
    months, days = (F.regexp_extract_all(text, F.lit(DATE_CODE), F.lit(g)) for g in (1, 2))
    return F.array_distinct(F.zip_with(months, days, lambda m, d: F.concat(m, d.cast("int").cast("string"))))
