"""Reading what models write."""

import json
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.functions import json_text as J
from pairloom.operators import attempts as A

WHOLE = {
    '[{"a":1}]': True,
    ' [1, 2] ': True,
    "[]": True,
    "[1] x ]": False,
    "[1],[2]": False,
    "[1]] x": False,
    '[1],"end of answer",null': False,
    "[1,]": False,
    "[NaN]": False,
    "['a']": False,
    "": False,
    "nothing": False,
    '{"a":1}': False,
}


def test_json_items(spark):
    df = spark.createDataFrame([(k,) for k in WHOLE], "t string")
    rows = df.select("t", J.json_items(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == WHOLE


def sliced(text):
    """Python's own reading of first and last bracket."""
    return text[text.find("[") : text.rfind("]") + 1] if "[" in text and text.rfind("]") > text.find("[") else ""


def test_slice(spark):
    texts = ["```json\n[1]\n```", "a [b] c [d] e", "no", "] [", "[ only", "only ]", "[]", "", "é[ü]ö", "[[["]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(J.slice_json_array(F.col("t")).alias("s")).collect()] == [sliced(t) for t in texts]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('[{"a":1}\n{"a":2}]', ('[{"a":1},{"a":2}]', True, None)),
        ('[{"a":1,\n"b":2 "c":3}]', ('[{"a":1,"b":2,"c":3}]', True, None)),
        ('[1 2\n3 4]', ("[1,2,3,4]", True, None)),
        ('["a"\n\n"b"]', ('["a","b"]', True, None)),
        ('[1,]', (None, False, "json_decode")),
        ('[{"a":"\\d"}]', (None, False, "invalid_escape")),
        ('[{"a":"\\u12"}]', (None, False, "invalid_escape")),
        ('[{"a":"x" "b":"\\q"}]', (None, False, "invalid_escape")),
        ('[{"a":"x"] [}', (None, False, "json_decode")),
        ('[1] [2]', (None, False, "json_decode")),
        ('[NaN, 1]', ('["NaN",1]', False, None)),
        ('[{"a":1,"a":2}]', ('[{"a":2}]', False, None)),
        ("", (None, False, "json_decode")),
        ("[" * 200000, (None, False, "json_decode")),
    ],
)
def test_reread(text, expected):
    assert J.reread(text) == expected


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(values, min_size=2, max_size=6), st.data())
def test_a_lost_comma_at_a_line_end_is_put_back(items, data):
    lines = [json.dumps(item) for item in items]
    gap = data.draw(st.integers(0, len(lines) - 2))
    text = "[\n" + "".join(line + ("\n" if i == gap or i == len(lines) - 1 else ",\n") for i, line in enumerate(lines)) + "]"
    fixed, mended, problem = J.reread(text)
    assert (mended, problem) == (True, None)
    assert json.loads(fixed) == items


def reread_step_by_step(text):
    """The rule itself: read, put one comma in, read again from the start."""
    mended = False
    while True:
        try:
            value = json.loads(text, parse_constant=str)
        except json.JSONDecodeError as error:
            if error.msg.startswith("Expecting ',' delimiter"):
                line_end = text.rfind("\n", 0, error.pos)
                at = error.pos if line_end < 0 or text[line_end - 1] == "," else line_end
                text, mended = f"{text[:at]},{text[at:]}", True
                continue
            return None, False, "invalid_escape" if "Invalid" in error.msg and "escape" in error.msg else "json_decode"
        return json.dumps(value, separators=(",", ":")), mended, None


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='[]{}:,"ab1 \n\\', max_size=30).map(lambda x: "[" + x + "]"))
def test_one_pass_finds_the_same_commas(text):
    assert J.reread(text) == reread_step_by_step(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(values, min_size=2, max_size=6), st.data())
def test_one_pass_with_any_lost_commas(items, data):
    text = json.dumps(items, indent=data.draw(st.sampled_from([None, 1])))
    places = [i for i, c in enumerate(text) if c == ","]
    for at in sorted(data.draw(st.sets(st.sampled_from(places), max_size=5)), reverse=True):
        text = text[:at] + text[at + 1 :]
    assert J.reread(text) == reread_step_by_step(text)


def test_many_missing_commas_are_quick():
    text = "[" + "\n".join('{"a":1}' for _ in range(16001)) + "]"
    start = time.time()
    fixed, mended, problem = J.reread(text)
    assert (mended, problem, fixed.count("},{")) == (True, None, 16000) and time.time() - start < 1


FIELDS = ("source_db_id", "target_db_id", "target_query")
GOOD = {"source_db_id": "s", "target_db_id": "t", "target_query": "q"}
ATTEMPTS = [
    # response, finish_reason, error, expected class, corrected
    (json.dumps([GOOD]), "", None, None, False),
    (json.dumps([GOOD, GOOD])[:-1].replace("}, {", "} {") + "]", "", None, None, True),
    ("Here: " + json.dumps([GOOD]) + " done", "", None, None, False),
    ("[]", "", None, None, False),
    (None, "", None, "empty_output", False),
    ("", "MAX_TOKENS", None, "empty_output", False),
    ("x", "MAX_TOKENS", None, "max_token", False),
    ("x", "max_token", None, "max_token", False),
    ("x", "RECITATION", None, "recitation", False),
    ("x", "", None, "json_decode", False),
    ("x", "", "timeout", "unexpected", False),
    (json.dumps([GOOD, {**GOOD, "more": 1}]), "", None, "fields_mismatch", False),
    (json.dumps([{"source_db_id": "s"}]), "", None, "fields_mismatch", False),
    (json.dumps([1, 2]), "", None, "fields_mismatch", False),
    (json.dumps([{**GOOD, "target_db_id": "other"}]), "", None, "db_id_matching", False),
    (json.dumps([{**GOOD, "source_db_id": None}]), "", None, "db_id_matching", False),
    (json.dumps([{**GOOD, "target_query": None}]), "", None, None, False),
    (json.dumps([{**GOOD, "target_query": {"x": 1}}]), "", None, None, False),
]


def attempts(spark):
    rows = [(i, r, f, e, "s", "t") for i, (r, f, e, _, _) in enumerate(ATTEMPTS)]
    return spark.createDataFrame(rows, "n int, response string, finish_reason string, error string, source_db_id string, target_db_id string")


def test_classes(spark):
    rows = A.classify(attempts(spark), FIELDS).orderBy("n").collect()
    assert [(r.error_class, r.corrected if r.error_class is None else False) for r in rows] == [(c, k) for *_, c, k in ATTEMPTS]


def test_switched_off_checks(spark):
    rows = A.classify(attempts(spark), FIELDS, check_fields=False, check_db_ids=False).orderBy("n").collect()
    for r, (*_, expected, _) in zip(rows, ATTEMPTS, strict=True):
        assert r.error_class == (None if expected in ("fields_mismatch", "db_id_matching") else expected)


def test_flags_at_most_one(spark):
    flags = A.classify(attempts(spark), FIELDS).select("error_class", A.error_flags(F.col("error_class")).alias("f"))
    for r in flags.collect():
        assert [name for name, on in r.f.asDict().items() if on] == ([r.error_class] if r.error_class else [])


def test_id_types_matter(spark):
    df = spark.createDataFrame([('[{"source_db_id":5,"target_db_id":"t"}]',)], "t string")
    n = J.db_id_mismatches(J.json_items(F.col("t")), F.lit("5"), F.lit("t"))
    assert df.select(n.alias("n")).first().n == 1


def test_field_values(spark):
    item = F.get(J.json_items(F.lit(json.dumps([{"a": "x", "b": {"c": [1]}, "d": None, "e": 7}]))), F.lit(0))
    row = spark.range(1).select(*[J.text_field(item, k).alias(k) for k in "abde"]).first()
    assert tuple(row) == ("x", '{"c":[1]}', None, "7")


def test_drifting_rating_names(spark):
    raw = [
        {"clarity_and_alignment_of_NL": {"is_clear_and_meaningful": "yes"}, "clarity": {"is_clear_and_meaningful": "no"}},
        {"clarity_x": {"is_clear_and_meaningful": "no"}},
        {"clarity_and_alignment_of_NL": {}},
        {"other": 1},
        {"clarity_and_alignment_of_NL": None, "clarity_z": {"is_clear_and_meaningful": "maybe"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)], "i int, t string")
    part = J.rating_part(F.parse_json("t"), "clarity_and_alignment_of_NL", "clarity")
    got = df.select("i", J.rating_value(part, "is_clear_and_meaningful").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["yes", "no", "N/A", "N/A", "N/A"]
