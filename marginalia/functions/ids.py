"""Identity of records: digests of canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of record kinds, and kinds whose id follows from their content.
PREFIX = {
    "source": "src", "unit": "unit", "lens": "lens", "activity": "act", "code": "code", "coding": "cdg", "memo": "memo",
    "claim": "clm", "judgment": "jdg", "failure": "fail",
}
CONTENT_ADDRESSED = ("source", "unit", "lens", "code")


def json_string(text: Column) -> Column:
    """A string as canonical JSON writes it: only quotes, backslashes and control characters are escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, name in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(name))
    rest = [c for c in range(32) if chr(c) not in "\b\f\n\r\t"]
    for code in rest:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def unit_id(source: Column, start: Column, end: Column, kind: Column) -> Column:
    """The id of a unit: where it is and what it is, nothing else."""
    text = F.concat(F.lit('{"end":'), end.cast("string"), F.lit(',"source":'), json_string(source), F.lit(',"start":'), start.cast("string"), F.lit(',"unit_kind":'), json_string(kind), F.lit("}"))
    return _digest("unit", text)


def _digest(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.left(F.sha2(text.cast("binary"), 256), F.lit(20)))


def canonical_text(text: str | None) -> str | None:
    """Canonical JSON of a JSON text; None where it does not parse, nests too deeply, or holds half of a surrogate pair, which no
    encoded text can hold."""
    try:
        out = None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return out if out is None or out.encode() else None
    except (ValueError, RecursionError):
        return None


def _canonical(body: pd.Series) -> pd.Series:
    return body.map(canonical_text)


def canonical(body_json: Column) -> Column:
    """JSON text with sorted keys and no blanks, other characters kept; null where it does not parse or cannot be written."""
    return F.pandas_udf(_canonical, "string")(body_json)


def content_id(prefix: str, body_json: Column) -> Column:
    """The id of an open body, given as JSON text in any order of keys."""
    return _digest(prefix, canonical(body_json))


def identity_of(kind: Column, body_json: Column) -> Column:
    """The id that a record's kind and content give; null for kinds whose id does not follow from it."""
    prefix = F.create_map(*[F.lit(x) for k in CONTENT_ADDRESSED for x in (k, PREFIX[k])])
    sha = F.left(F.sha2(canonical(body_json).cast("binary"), 256), F.lit(20))
    return F.concat(F.try_element_at(prefix, kind), F.lit(":"), sha)
