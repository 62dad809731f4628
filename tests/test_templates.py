"""Request texts: set between the template's pieces where that equals the chain of replacements."""

from pyspark.sql import functions as F

from rankwise.operators import templates

WS = "".join(map(chr, [*range(9, 14), *range(28, 32), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _chain(template, values, static):
    for name in templates.STATIC_ORDER:
        if name in static:
            template = template.replace("{" + name + "}", static[name].strip())
    for name in templates.DYNAMIC_ORDER:
        if name in values:
            template = template.replace("{" + name + "}", (values[name] or "").strip(WS))
    return template


def test_render_equals_the_chain(spark):
    texts = ["plain", "  two\nlines ", "", None, "{REQUIREMENT_SPECIFICATION} {CV_TEXT}", "{REQUIREMENT_", "CV_TEXT}", "a } b { c", "\U0001F600 "]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "cv string, spec string")
    static = templates.static_values()
    for template in (templates.TEMPLATES["match"], "{CV_TEXT}{CV_TEXT}", "no place", "{{REQUIREMENT_SPECIFICATION}: {CV_TEXT} {", "{EMPTY_SCORE}{CV_TEXT}"):
        for given in (template, F.lit(template)):
            out = templates.render(given, {"CV_TEXT": F.col("cv"), "REQUIREMENT_SPECIFICATION": F.col("spec")})
            for r in df.select("cv", "spec", out.alias("o")).collect():
                assert r.o == _chain(template, {"CV_TEXT": r.cv, "REQUIREMENT_SPECIFICATION": r.spec}, static), (template, r)


def test_pieces_of_a_template():
    names = ["TEXT", "CV_TEXT"]
    assert templates._whole_pieces("a {CV_TEXT} b {TEXT}", names) == ["a ", "CV_TEXT", " b ", "TEXT", ""]
    assert templates._whole_pieces("a {CV_{TEXT}", names) is None  # the text may be "TEXT}"
    assert templates._whole_pieces('{"value": {TEXT}}', names) == ['{"value": ', "TEXT", "}"]
    assert len(templates._whole_pieces(templates.TEMPLATES["match"], ["CV_TEXT", "REQUIREMENT_SPECIFICATION"])) == 5
