"""Column functions on small golden cases."""

from pyspark.sql import functions as F

from marginalia.functions import answers as An
from marginalia.functions import names as N
from marginalia.functions import text as T
from marginalia.functions.ids import content_id, json_string, unit_id


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lines(spark):
    lines = ["= Title =", "* [https://example.org x]", "https://example.org/d.json", "[[SomePage]]", "More soon. -- Oct21Keeper", "* More soon. -- Oct21Keeper", "* [https://example.org x] -- Oct21Keeper", "plain words", "ask -- Name_1 ?\u3000", "-- Ab"]
    assert column(spark, lines, T.classify_line) == ["heading", "list", "list", "list", "signed", "signed", "list", "plain", "signed", "plain"]
    assert column(spark, lines[4:5] + lines[8:], T.signature_of) == ["Oct21Keeper", "Name_1", None]
    assert column(spark, lines[4:5] + lines[8:9], T.signature_uncertain) == [False, True]


def test_white_space(spark):
    assert column(spark, ["  a \u00a0\x1c b\u2003", "", "\x85"], T.collapse_ws) == ["a b", "", ""]
    assert column(spark, ["  Two\tWords "], T.name_key) == ["two words"]


def test_strip_signature(spark):
    rows = spark.createDataFrame([("body text -- A.b ?", "A.b"), ("no end -- X here", "X"), ("t -- Q\\E", "Q\\E"), ("kept", None)], "t string, s string")
    out = [r.x for r in rows.select(T.strip_signature(F.col("t"), F.col("s")).alias("x")).collect()]
    assert out == ["body text ", "no end -- X here", "t ", "kept"]
    rows = spark.createDataFrame([("a line -- Cy", "Cy"), ("a line", "Cy")], "t string, s string")
    assert [r.x for r in rows.select(T.body_of(F.col("t"), F.col("s")).alias("x")).collect()] == ["a line", "a line"]


def test_days(spark):
    times = ["2026-06-18T04:48:38Z", "2026-06-18T04:48:38.25Z", "2026-06-18 04:48", ""]
    assert column(spark, times, T.day_of) == ["2026-06-18", "2026-06-18", "unknown day", "unknown day"]


def test_matches_and_snippets(spark):
    out = column(spark, ["an ant and a man", "zz", ""], lambda c: T.find_matches(c, "an"))
    assert [[(m.start, m.end, m.said) for m in x] for x in out] == [[(0, 2, "an"), (3, 5, "an"), (7, 9, "an"), (14, 16, "an")], [], []]
    assert column(spark, ["0123456789"], lambda c: T.snippet(c, F.lit(4), F.lit(6), 2)) == ["…234567…"]
    assert column(spark, ["0123456789"], lambda c: T.clip(c, F.lit(0), F.lit(2), 4)) == ["0123…"]
    assert column(spark, ["äbc"], lambda c: T.byte_at(c, F.lit(2))) == [3]


def test_names(spark):
    names = ["BlueScoutAug08", "OpenAIAug8Watcher", "RiverScoutAprSix", "BotLongTable22", "ProbeHelperJune", "QFeb031999021455", "OurTeam", "AugustThirty", "Feb0"]
    assert column(spark, names[:1], N.name_parts) == [["Blue", "Scout", "Aug", "08"]]
    assert column(spark, names, N.date_of) == ["Aug8", "Aug8", "Apr6", None, None, "Feb3", None, "Aug30", None]
    assert column(spark, names[:4] + names[6:7], N.kinds_of) == [["role", "date"], ["institution", "role", "date"], ["role", "date"], ["role"], ["collective"]]
    assert column(spark, ["OurScoutMay2"], lambda c: N.name_features(c, ("May", "Scout"))) == [["role", "role:Scout", "collective", "collective:Our", "date", "part:Scout", "part:May"]]
    assert column(spark, ["on Aug 8, August 08 and xAug9; Sept 300"], N.date_codes) == [["Aug8"]]


def test_ids(spark):
    import hashlib
    import json

    strings = ['a"b\\c', "line\nfeed\ttab", "\x01\x1f", "ünï ", ""]
    assert column(spark, strings, json_string) == [json.dumps(s, ensure_ascii=False) for s in strings]
    body = {"name": "é\n", "b": [1, {"z": None, "a": True}], "a": "x"}
    want = "code:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:20]
    assert column(spark, [json.dumps(body), "{"], lambda c: content_id("code", c)) == [want, None]
    unit = {"source": "src:1", "start": 3, "end": 9, "unit_kind": "post"}
    want = "unit:" + hashlib.sha256(json.dumps(unit, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]
    assert column(spark, ["src:1"], lambda c: unit_id(c, F.lit(3), F.lit(9), F.lit("post"))) == [want]


def test_quotations(spark):
    texts = ['One line was "the kettle boiled over" again.', "One line was ‘the kettle boiled over’ again.", "It isn't what the cooks' own notes tell", "They ask 'don't open it before the bell rings' of all.", '"brief" and a long way on "small"', "'a lid without a pot' before \"a pot without a lid\" and 'a lid without a pot'", None]
    want = [["the kettle boiled over"], ["the kettle boiled over"], [], ["don't open it before the bell rings"], [], ["a lid without a pot", "a pot without a lid"], []]
    assert column(spark, texts, An.quotations) == want
    assert column(spark, texts[1:2], lambda c: An.quotations(c, single=False)) == [[]]


def test_answers(spark):
    raw = ['{"a": 1}', '\ufeff {"a": 1}\n', 'See:\n```json\n{"a": [1]}\n```\nDone.', 'The answer is {"a": 1}.', '```\n{"a": 1}\n```\n```\n{"a": 2}\n```', '{"a": NaN}', '{"a": 1, "a": 2}', "[1]", None]
    out = column(spark, raw, An.parse_answer)
    assert [x is not None for x in out] == [True, True, True, False, False, False, True, False, False]
    raw = ['```JSON lines\n{"a": 1}```', '```{"a": 1}```', '  \n']
    assert column(spark, raw, An.parse_answer) == ['{"a": 1}', None, None]
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "maxItems": 1, "items": {"type": "string", "minLength": 2}}, "b": {"enum": ["x"]}}}
    texts = ['{"a": ["ok"]}', '{"a": ["o", "ok"]}', '{"b": "y", "c": 1}', '{"a": 1}', None]
    want = [[], ["$.a: more than 1 items", "$.a[0]: shorter than 2"], ["$.a: missing", "$.b: not one of the allowed values", "$.c: not expected"], ["$.a: expected array"], ["$: not a JSON object"]]
    assert column(spark, texts, lambda c: An.validate_answer(c, schema)) == want


def test_schemas_in_full():
    whole = {"type": "integer"}
    assert [An.problems(x, whole) == [] for x in (3, 3.0, 3.5, True, "3")] == [True, True, False, False, False]
    assert An.problems([1], {"items": False}) == ["$[0]: not allowed"] and An.problems({"x": 1}, {"additionalProperties": {"type": "string"}}) == ["$.x: expected string"]
    assert [An.problems(x, {"enum": [1, [0]]}) == [] for x in (1, 1.0, True, [0], [False])] == [True, True, False, True, False]
    wrong = {"type": "text", "pattern": "a", "minItems": -1, "required": "a", "items": {"anyOf": []}, "properties": {"p": 3}, "title": "t"}
    assert An.schema_problems(wrong) == ["schema.pattern: constraint not supported", "schema.type: unknown type text", "schema.required: wrong shape", "schema.minItems: not a count", "schema.items.anyOf: constraint not supported", "schema.properties.p: neither an object nor true or false"]


def test_replies_with_one_object(spark):
    fence = "`" * 3
    raw = ['{see}\n' + fence + '\n{"a": 1}\n' + fence + '\n{end}', '\x1c{"a": 1}\u3000', fence + 'x\n \u00a0{"a": 2}\n\n' + fence, '{"a": 1} and more}', '{"a": ' + "[" * 100_000 + "]" * 100_000 + "}", '{"a": 1e999}', '{"a": "\\ud800"}', "{", ""]
    assert column(spark, raw, An.parse_answer) == ['{"a": 1}', '{"a": 1}', '{"a": 2}', None, None, '{"a": 1e999}', '{"a": "\\ud800"}', None, None]


def test_validation_never_raises(spark):
    """Numbers out of range, malformed schemas, names that are no Unicode, and deep nesting are problems, not errors."""
    check = lambda text, schema: column(spark, [text], lambda c: An.validate_answer(c, schema))[0]
    assert check('{"a": 1e999}', {"properties": {"a": {"type": "integer"}}}) == ["$.a: expected integer"]
    assert check('{"a": -1e999}', {"properties": {"a": {"type": "number"}}}) == ["$.a: expected number"]
    assert check('{"a": [1]}', {"properties": {"a": {"items": [{"type": "string"}]}}}) == ["schema.properties.a.items: neither an object nor true or false"]
    assert check('{"a": 1}', {"properties": ["a"]}) == ["schema.properties: wrong shape"]
    assert check('{"a": "x"}', {"properties": {"a": {"minLength": "3"}}}) == ["schema.properties.a.minLength: not a count"]
    assert check('{"a": 1}', {"type": 5}) == ["schema.type: unknown type 5"]
    assert check("{}", {"required": "ab"}) == ["schema.required: wrong shape"] and check("{}", {"required": ["a", 1]}) == ["schema.required: wrong shape"]
    assert check("{}", {"type": ["object", {}], "enum": 3, "maxItems": True}) == ["schema.type: unknown type {}", "schema.enum: wrong shape", "schema.maxItems: not a count"]
    assert check("{}", 7) == ["schema: neither an object nor true or false"] and check("{}", False) == ["$: not allowed"] and check("{}", True) == []
    assert check('{"\\ud800": 1}', {"additionalProperties": False}) == ["$.?: not expected"]
    deep = '{"a": ' + "[" * 700 + "]" * 700 + "}"
    assert check(deep, {"items": {"type": "string"}}) == [] and len(check(deep, {"properties": {"a": {"enum": [1]}}})) == 1


def test_problems_in_order():
    schema = {"required": ["z", "a"], "properties": {"a": {"type": ["array", "null"], "minItems": 3, "enum": [None], "items": {"required": ["k"]}}, "b": {"minLength": 2}}, "additionalProperties": {"type": "boolean"}}
    value = {"b": "é", "a": [{}, {"k": 1}], "c": 0}
    assert An.problems(value, schema) == ["$.z: missing", "$.b: shorter than 2", "$.a: not one of the allowed values", "$.a: fewer than 3 items", "$.a[0].k: missing", "$.c: expected boolean"]
    assert An.problems({"a": None, "z": True}, schema) == []
    same = [({"x": [1, {"y": True}]}, {"x": [1.0, {"y": True}]}, True), ({"x": 1}, {"x": True}, False), ([], {}, False), ("1", 1, False), (0, False, False), (10**20, 1e20, True), ({"a": 1, "b": 2}, {"b": 2, "a": 1}, True)]
    assert [An.problems(a, {"enum": [b]}) == [] for a, b, _ in same] == [x for *_, x in same]


def test_canonical_never_raises(spark):
    from marginalia.functions.ids import canonical

    texts = ['{"b": 1.0, "a": [true, null, "é"]}', '{"a": "\\ud800"}', '{"a": "\\ud83d\\ude00"}', "[" * 100_000, "x", None]
    assert column(spark, texts, canonical) == ['{"a":[true,null,"é"],"b":1.0}', None, '{"a":"\U0001f600"}', None, None, None]


def test_snippet_between_words(spark):
    text = "one two three four five six seven eight nine ten"
    cut = lambda at, end, width: column(spark, [text], lambda c: T.snippet_words(c, F.lit(at), F.lit(end), width))[0]
    assert cut(19, 23, 14) == "four five six" and cut(0, 3, 9) == "one two" and cut(45, 48, 11) == "nine ten" and cut(19, 23, 400) == text and cut(8, 23, 4) == "three four five"


def test_identity(spark):
    from marginalia.functions.ids import identity_of

    rows = spark.createDataFrame([("code", '{"b": 1, "a": 2}'), ("coding", "{}"), ("lens", "{")], "kind string, body string")
    got = [r.x for r in rows.select(identity_of(F.col("kind"), F.col("body")).alias("x")).collect()]
    assert got[0].startswith("code:") and len(got[0]) == 25 and got[1:] == [None, None]
