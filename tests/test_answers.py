"""Answer parsing (X15/P3), requirement extraction (P2), templates."""

import json

from pyspark.sql import functions as F

from rankwise.operators import answers as ans, templates
from rankwise.schemas import requirement_types

FIELDS = {"value": "int", "explanation": "str"}


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, answer string")
    return {r["id"]: (r["value"], r["explanation"], r["reason"])
            for r in ans.parse_answers(df, "answer", FIELDS).collect()}


def test_lax_values_and_rejects(spark):
    got = _parse(spark, [
        'ok {"value": "85", "explanation": " fine "} end',
        '{"value": 85.0, "explanation": "x"}',
        '{"value": 85.5, "explanation": "x"}',
        '{"value": "high", "explanation": "x"}',
        'no braces at all',
        '{"value": 1, "explanation": "a\nb"}',
        '{"value": 1, "explanation": "x"} {"value": 2}',
        '{"value": 1, "explanation": "x"} }',
        '{"value": 1}',
        '{"value": 1, "explanation": "x", "extra": {"k": 1}}',
        '{"value": 1, "explanation": "has } brace"}',
    ])
    assert got[0] == (85, "fine", None)
    assert got[1][0] == 85 and got[1][2] is None
    assert got[2][2] == "bad_value" and got[3][2] == "bad_value"
    assert got[4][2] == "no_json"
    assert got[5] == (1, "a\nb", None)
    assert got[6][2] == "not_one_object" and got[7][2] == "not_one_object"
    assert got[8][2] == "missing_explanation"
    assert got[9][2] is None and got[10][2] is None


def test_field_types(spark):
    got = _parse(spark, [
        '{"value": 1, "explanation": 5}', '{"value": 1, "explanation": ["x"]}', '{"value": true, "explanation": "x"}',
        '{"value": [1], "explanation": "x"}', '{"value": 1e2, "explanation": "x"}', '{"value": null, "explanation": "x"}',
        '{"value": 1, "explanation": "x"', '{"value": 1, "value": 2, "explanation": "x"}', '{"explanation": "x"}', None, ""])
    assert [got[i][2] for i in range(9)] == ["bad_explanation", "bad_explanation", None, "bad_value", None, "bad_value",
                                             "no_json", None, "missing_value"]
    assert got[2][0] == 1 and got[4][0] == 100 and got[7][0] == 2
    assert got[9][2] == "no_json" and got[10][2] == "no_json"


def test_lax_booleans(spark):
    texts = ["true", '"Yes"', "1", "1.0", "0.0", '"off"', "2", '"maybe"', "null", "[true]"]
    df = spark.createDataFrame([(i, '{"promising": %s}' % t) for i, t in enumerate(texts)], "id int, answer string")
    got = {r["id"]: (r["promising"], r["reason"]) for r in ans.parse_answers(df, "answer", {"promising": "bool"}).collect()}
    assert [got[i][0] for i in range(10)] == [True, True, True, True, False, False, None, None, None, None]
    assert all(got[i][1] == "bad_promising" for i in range(6, 10)) and all(got[i][1] is None for i in range(6))


def test_long_answers(spark):
    """An explanation of a megabyte with quotes, braces and backslashes."""
    long = 'it\'s "quoted" {not} a \\ brace } ' * 40_000
    text = "Sure: " + json.dumps({"value": 7, "explanation": long}) + " done"
    assert len(text) > 1_000_000
    got = _parse(spark, [text, text + " {}"])
    assert got[0] == (7, long.strip(), None) and got[1][2] == "not_one_object"


def test_bad_extraction_answers_keep_a_row(spark):
    texts = ["nothing", '{"education": [', '{"education": []} {"x": 1}', '{"education": [{"type": "mandatory", "specification": 7}]}',
             '{"education": [{"type": 3, "specification": "x"}]}', "{}", None, '{"education": [}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    got = {r["id"]: (r["req_type"], r["reason"]) for r in ans.parse_requirements(df, "answer", requirement_types(spark)).collect()}
    assert got == {0: (None, "no_json"), 1: (None, "no_json"), 2: (None, "not_one_object"), 3: ("education", "bad_specification"),
                   4: ("education", "bad_type"), 6: (None, "no_json"), 7: (None, "malformed")}


def test_requirement_extraction(spark):
    text = json.dumps({"education": [{"type": "mandatory", "specification": " MSc "}, "loose", 3],
                       "travel": "not a list", "unknown": [{"type": "optional", "specification": "x"}],
                       "languages": [{"type": "required", "specification": "German"}, {"type": "optional"}]})
    df = spark.createDataFrame([(1, "Here: " + text)], "id int, answer string")
    rows = ans.parse_requirements(df, "answer", requirement_types(spark)).orderBy("req_type", "req_pos").collect()
    got = [(r["req_type"], r["req_pos"], r["kind"], r["specification"], r["reason"]) for r in rows]
    assert got == [("education", 0, "mandatory", "MSc", None),
                   ("languages", 0, "required", "German", "bad_type"),
                   ("languages", 1, "optional", None, "missing_specification")]


def test_answer_step_dedups_requests(spark):
    req = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "rid int, prompt string")
    calls = []

    def scorer(keys):
        calls.append(keys.count())
        return keys.withColumn("answer", F.upper("prompt"))

    out = {r["rid"]: r["answer"] for r in ans.answer(req, ["prompt"], scorer).collect()}
    assert out == {1: "A", 2: "A", 3: "B"} and calls == [2]


def test_template_order_and_nesting(spark):
    df = spark.createDataFrame([("cv {REQUIREMENT_TYPE_NAME}", " spec ", "education", "def")],
                               "cv string, spec string, t string, d string")
    text = df.select(templates.match_request(F.col("cv"), F.col("spec"), F.col("t"), F.col("d")).alias("p")).first()["p"]
    # the CV text itself contains a later placeholder: it is replaced too (sequential semantics)
    assert "cv education" in text and '"spec"' in text and "{" + "CV_TEXT}" not in text
    shapes = templates.sample_shapes()
    assert json.loads(shapes["EMPTY_SCORE"]) == {"value": 0, "explanation": "explanation of the value"}
    assert set(json.loads(shapes["EMPTY_REQUIREMENTS"])) == {t for t, _ in __import__(
        "rankwise.schemas", fromlist=["x"]).REQUIREMENT_TYPES}


def test_pandas_scorer_through_answer_step(spark):
    req = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy")], "rid int, prompt string")

    def judge(prompts):
        return prompts.map(lambda p: '{"value": %d, "explanation": "len"}' % (10 * len(p)))

    out = ans.answer(req, ["prompt"], ans.pandas_scorer(judge, "prompt", parallelism=2))
    parsed = ans.parse_answers(out, "answer", FIELDS)
    assert {r["rid"]: r["value"] for r in parsed.collect()} == {1: 10, 2: 10, 3: 20}
