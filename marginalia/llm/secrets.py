"""Secret scans with DataFrame functions only: known shapes, and strings that look random.

A run of 20 or more characters of an encoding's alphabet is a candidate where its characters suggest hexadecimal, base32
or base64. Two p-values are found under the assumption that a candidate is *not* random: chi-squared uniformity over the
alphabet, where the symbols of written words or numbers would repeat more often, and the number of runs of one kind of
symbol (capitals, small letters, digits), where written names change kind less often; Fisher's rule combines them. A runs
test of high and low symbols and a lag-1 serial correlation test must not speak against randomness; a candidate against
which one does keeps its place among the hypotheses with p = 1. Benjamini-Hochberg control over all candidates of a length
class, for each class by itself, decides which ones are reported, so that short strings, which can never have very small
p-values, neither drown among long dull ones nor hold up long random ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, with_columns

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SOME_ASSIGN = ASSIGN[:-2] + "{6,})"
#: Whole runs of at least the wanted length; shorter runs would be dropped after the match anyway.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random_hex", "random_base32", "random_base64")

#: Alphabet, the chance that two (three) symbols of a text that is not random are equal (for base32 and base64 that of
#: English letters, for hexadecimal that of decimal digits), and where in the alphabet another kind of symbol begins; too
#: few symbols of base32 are digits for runs of kinds to tell anything.
ENCODINGS = {
    "random_hex": ("0123456789abcdef", 0.1, 0.01, (10,)),
    "random_base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0655, 0.0053, ()),
    "random_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0655, 0.0053, (26, 52, 62)),
}
#: How often neighbours are of different kinds in names such as someLongNameOf2Words, at most.
CHANGES = 0.4
#: Where length classes begin.
LENGTHS = (24, 32, 48, 96)
#: False-discovery rate, and the level of the tests that must not reject randomness.
RATE, LEVEL = 0.01, 0.001
_BINS, _PER_DECADE = 3000, 50


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable (polynomial approximation, absolute error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, q).otherwise(1 - q)


def _matches(text: Column, pattern: str, some: str | None, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches as ``kind, skip`` (code points since the last match), ``size``, ``ok, said``."""
    none = F.array().cast("array<struct<kind:int,skip:int,size:int,ok:boolean,said:string>>")

    def one(m: Column, gap: Column) -> Column:
        said = m if kind >= 3 else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("skip"), F.length(m).alias("size"), keep(m).alias("ok"), said.alias("said"))

    zipped = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), one)
    return F.when(text.rlike(some or pattern), F.filter(zipped, lambda x: x["size"].isNotNull())).otherwise(none)


def _encoding(said: Column) -> Column:
    digit, upper, lower = said.rlike("[0-9]"), said.rlike("[A-Z]"), said.rlike("[a-z]")
    return (
        F.when(said.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & said.rlike("[a-fA-F]"), 3)
        .when(said.rlike("^[A-Z2-7]+$") & digit & upper, 4)
        .when(digit & upper & lower, 5)
    )


def _tested(rows: DataFrame) -> DataFrame:
    """Candidates of known encoding with their ``class`` of length and ``p``, the p-value of looking as random as this
    without being random, or 1 where a test speaks against randomness."""
    out = rows.withColumn("code", _encoding(F.col("said"))).filter("code is not null")
    parts = []
    for name, (alphabet, pairs, triples, kinds) in ENCODINGS.items():
        own = out.filter(F.col("code") == KINDS.index(name))
        head, tail = (lambda c: F.slice(c, 1, F.size(c) - 1)), (lambda c: F.slice(c, 2, F.size(c) - 1))
        said = F.lower("said") if name == "random_hex" else F.translate("said", "-_", "+/")
        k = len(alphabet)
        own = own.withColumn("x", F.transform(F.split(said, ""), lambda c: F.instr(F.lit(alphabet), c) - 1))
        own = own.withColumn("n", F.size("x").cast("double"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.size(F.filter("x", lambda v: v == i)))
        own = own.withColumn("equal", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1.0)))
        n = F.col("n")
        mean = n * (n - 1) * pairs
        var = 4 * n * (n - 1) * (n - 2) * (triples - pairs**2) + 2 * n * (n - 1) * (pairs - pairs**2)
        # chi-squared over k symbols is k / n * (equal + n) - n: fewer equal pairs, more uniform
        own = own.withColumn("p_text", upper_tail((mean - F.col("equal")) / F.sqrt(var)))
        if kinds:
            own = own.withColumn("kinds", F.transform("x", lambda v: sum((F.when(v >= at, 1).otherwise(0) for at in kinds), F.lit(0))))
            own = own.withColumn("changes", F.aggregate(F.zip_with(head("kinds"), tail("kinds"), lambda a, b: (a != b).cast("int")), F.lit(0.0), lambda a, v: a + v))
            p_kinds = upper_tail((F.col("changes") - 0.5 - (n - 1) * CHANGES) / F.sqrt((n - 1) * (CHANGES * (1 - CHANGES))))
            both = F.greatest(F.col("p_text") * p_kinds, F.lit(1e-290))
            own = own.withColumn("p_text", both * (1 - F.log(both)))  # of two p-values, by Fisher's rule
        own = own.withColumn("high", F.transform("x", lambda v: (v * 2 >= k).cast("int")))
        own = own.withColumn("n1", F.aggregate("high", F.lit(0.0), lambda a, v: a + v)).withColumn("n0", n - F.col("n1"))
        own = own.withColumn("runs", F.aggregate(F.zip_with(head("high"), tail("high"), lambda a, b: F.abs(a - b)), F.lit(1.0), lambda a, v: a + v))
        own = own.withColumn("mu", 2 * F.col("n1") * F.col("n0") / n + 1)
        z_runs = (F.col("runs") - F.col("mu")) / F.sqrt(F.greatest((F.col("mu") - 1) * (F.col("mu") - 2) / (n - 1), F.lit(1e-9)))
        own = own.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n)
        own = own.withColumn("d", F.transform("x", lambda v: v - F.col("m")))
        serial = F.aggregate(F.zip_with(head("d"), tail("d"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / F.greatest(F.aggregate("d", F.lit(0.0), lambda a, v: a + v * v), F.lit(1e-9))
        z_serial = (serial + 1 / (n - 1)) * F.sqrt(n)
        random = (2 * upper_tail(F.abs(z_runs)) >= LEVEL) & (2 * upper_tail(F.abs(z_serial)) >= LEVEL)
        length = sum((F.when(n >= at, 1).otherwise(0) for at in LENGTHS), F.lit(0))
        parts.append(own.select(*rows.columns, "code", length.alias("class"), F.when(random, F.col("p_text")).otherwise(1.0).alias("p")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _cutoffs(tested: DataFrame, rate: float) -> dict[int, float]:
    """For each class of length the largest p-value that the Benjamini-Hochberg rule accepts over all its candidates, to a
    fiftieth of a power of ten."""
    step = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-60))) * _PER_DECADE), F.lit(_BINS)).cast("int")
    counts = tested.groupBy("class", F.greatest(step, F.lit(0)).alias("bin")).count().collect()  # a row for each class and bin at most
    out = {}
    for k in range(len(LENGTHS) + 1):
        mine = sorted(((r["bin"], r["count"]) for r in counts if r["class"] == k), reverse=True)
        total, so_far = sum(n for _, n in mine), 0
        for at, n in mine:
            so_far += n
            if 10.0 ** (-at / _PER_DECADE) <= rate * so_far / total:
                out[k] = 10.0 ** (-at / _PER_DECADE)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Add ``secrets`` (structs ``kind, start, end`` in code points, by start, then kind in the order of ``KINDS``) and
    the counts ``n_assign, n_access, n_hex, n_random``. A random string is reported unless it overlaps a known shape.

    Null or empty texts have none; repeated rows are reported alike; rows may share an id or have none; an empty table
    gives an empty result; other columns pass through, whatever their names.

    Patterns run where the texts are read; only matches travel on, a row each, and are placed by running sums inside
    their document, so that a text of very many matches costs no more than sorting them.
    """
    text, id_ = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select(id_.alias("id"), F.xxhash64(text).alias("row"), text.alias("t"))
    t = F.col("t")
    yes = lambda m: F.lit(True)
    groups = F.array(
        _matches(t, ASSIGN, SOME_ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        _matches(t, ACCESS, None, 1, yes),
        _matches(t, HEX, None, 2, yes),
        _matches(t, CANDIDATE, None, 3, yes),
    )
    hits = keyed.select("id", "row", F.explode(groups).alias("g")).filter("size(g) > 0").select("id", "row", F.posexplode("g").alias("i", "h")).select("id", "row", "i", "h.*").distinct()
    along = Window.partitionBy("id", "row", "kind").orderBy("i")
    end = F.sum(F.col("skip") + F.col("size")).over(along)
    placed = hits.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("size")).filter("ok").select("id", "row", "kind", "start", "end", "said")
    scratch = Scratch(docs.sparkSession)
    placed = scratch.write(placed, "matches")
    base = placed.filter("kind < 3").select("id", "row", "kind", "start", "end", F.lit(None).cast("double").alias("p"))
    tested = scratch.write(_tested(placed.filter("kind >= 3")), "tested")
    allowed = F.lit(-1.0)
    for k, cutoff in _cutoffs(tested, rate).items():
        allowed = F.when(F.col("class") == k, cutoff).otherwise(allowed)
    random = tested.filter(F.col("p") <= allowed).select("id", "row", F.col("code").alias("kind"), "start", "end", "p")
    before = Window.partitionBy("id", "row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("id", "row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = base.unionByName(random).withColumn("left", F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before)).withColumn("right", F.min(F.when(F.col("kind") < 3, F.col("start"))).over(after))
    alone = (F.coalesce("left", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("right"), F.lit(2**62)) >= F.col("end"))
    kept = both.filter((F.col("kind") < 3) | alone)
    names = F.array(*map(F.lit, KINDS))
    listed = kept.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("_m_found"))
    listed = listed.select(F.col("id").alias("_m_of"), F.col("row").alias("_m_of_row"), "_m_found")
    listed = scratch.keep(listed, "listed")
    out = docs.withColumns({"_m_id": id_, "_m_row": F.xxhash64(text)})
    out = out.join(listed, (F.col("_m_id") == F.col("_m_of")) & (F.col("_m_row") == F.col("_m_of_row")), "left")
    found = F.coalesce("_m_found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))

    def count(low: int, high: int) -> Column:
        return F.size(F.filter(found, lambda x: x["kind"].between(low, high))).cast("long")

    secrets = F.transform(found, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    cols = {"secrets": secrets} | {f"n_{k}": count(i, i) for i, k in enumerate(KINDS[:3])} | {"n_random": count(3, len(KINDS) - 1)}
    return with_columns(out, **cols).drop("_m_id", "_m_row", "_m_of", "_m_of_row", "_m_found")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: ~x["kind"].startswith("random"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"), "n_random")
