"""Text jobs: replacement chain, redaction, links, language tags, pseudonyms, names, pages."""

import pytest
from pyspark.sql import functions as F

from rankwise.functions.columns import ballot_timestamp, label_suffix, name_set, strip_unicode
from rankwise.operators import text as tx


def test_nbsp_zwsp_and_strip(spark):
    df = spark.createDataFrame([("a\u00a0b\u200bc", "\u3000 x  \n")], "t string, s string")
    r = tx.normalise_documents(df, "t").select("t", strip_unicode("s").alias("s")).first()
    assert r["t"] == "a b c" and r["s"] == "x"


def test_redaction_order_and_hits(spark):
    df = spark.createDataFrame([(1, "the cat and the dog")], "id int, text string")
    r = tx.redact(df, "text", [("the", "[A]"), ("[A] cat", "[B]")]).first()
    assert r["redacted"] == "[B] and [A] dog" and r["hits_0"] == 2 and r["hits_1"] == 1


def test_parse_rules(spark):
    lines = spark.createDataFrame([("# comment",), ("Anna>Person A",), ("bad line",), ("",)], "value string")
    rows = tx.parse_rules(lines).collect()
    assert [(r["old"], r["new"], r["reason"]) for r in rows] == [("Anna", "Person A", None),
                                                                   ("bad line", None, "bad_rule")]


def test_link_removal(spark):
    df = spark.createDataFrame([('<p>See <a href="http://x.y">the site</a> or https://a.b/c now</p>',)], "html string")
    assert tx.strip_links(df).first()["html"] == "<p>See the site or  now</p>"


def test_language_tags(spark):
    df = spark.createDataFrame([(1, "the cat and the dog is on the mat"), (2, "le chat et les chiens dans la"),
                                (3, "xyz qqq")], "id int, text string")
    got = {r["id"]: r["detected"] for r in tx.detect_language(df, "id").collect()}
    assert got == {1: "en", 2: "fr", 3: None}


def test_pseudonyms_unique_and_valid(spark):
    ids = spark.range(0, 30).withColumnRenamed("id", "sid")
    fn = spark.createDataFrame([("Anna",), ("Bert",), ("Cleo",)], "f string")
    sn = spark.createDataFrame([(f"Size{i}",) for i in range(8)], "s string")
    out = tx.name_checks(tx.pseudonyms(ids, "sid", fn, sn, seed=42)).collect()
    names = [r["name"] for r in out]
    # 3 x 8 names, then the names go round with a number
    assert len(set(names)) == 30 and all(r["valid_name"] for r in out)
    assert sum(n.endswith("-2") for n in names) == 6
    two_words = spark.createDataFrame([("Saudi arabia",), ("Anna",)], "f string")
    assert {r["name"].split()[0] for r in tx.pseudonyms(ids, "sid", two_words, sn).collect()} == {"Anna"}
    again = tx.pseudonyms(ids, "sid", fn, sn, seed=42).collect()
    assert {r["sid"]: r["name"] for r in again} == {r["sid"]: r["name"] for r in out}


def test_page_assembly_order(spark):
    pages = spark.createDataFrame([(1, 2, " second "), (1, 1, "first\n"), (2, 1, "x")], "d int, p int, t string")
    got = {r["d"]: r["text"] for r in tx.assemble_pages(pages, ["d"], "p", "t").collect()}
    assert got == {1: "first\nsecond", 2: "x"}


def test_ballot_columns(spark):
    df = spark.createDataFrame([("2025/05/02 7:15:09 AM GMT+1", "Place of Anna Berg", "a;b;a")], "ts string, l string, p string")
    r = df.select(ballot_timestamp("ts").alias("t"), label_suffix("l").alias("n"),
                  F.array_sort(name_set("p")).alias("s")).first()
    assert str(r["t"]) == "2025-05-02 06:15:09" and r["n"] == "Anna Berg" and r["s"] == ["a", "b"]


def test_rule_file_and_translation_memory(spark, tmp_dir):
    path = f"{tmp_dir}/rules.txt"
    with open(path, "w") as f:
        f.write("# names\nAnna>Person A\nBerg>Surname B\n")
    rules = tx.load_rules(spark, path)
    assert rules == [("Anna", "Person A"), ("Berg", "Surname B")]
    with open(f"{tmp_dir}/bad.txt", "w") as f:
        f.write("Anna>X>Y\n")
    with pytest.raises(ValueError):
        tx.load_rules(spark, f"{tmp_dir}/bad.txt")
    docs = spark.createDataFrame([(1, "hallo welt", "de"), (2, "hello", "en"), (3, "hola", "es")],
                                 "id int, text string, lang string")
    memory = docs.filter("id = 1").select(F.md5("text").alias("text_md5"), F.lit("hello world").alias("translated"))
    todo = tx.translation_work_list(docs, "text", "lang", memory)
    assert [r["lang"] for r in todo.collect()] == ["es"]
    out = {r["id"]: r["text"] for r in tx.apply_translations(docs, "text", memory).collect()}
    assert out == {1: "hello world", 2: "hello", 3: "hola"}


def test_records_are_translated_in_place(spark):
    """Nulls, empty lists, repeated and unknown texts; nothing happens in the native language; null keys are records too."""
    m = lambda v, e, t, s: ((v, e), (t, s))
    rows = [(1, (0.5, (True, "yes"), {"a": [m(1, "why", "must", "spec"), m(2, "spec", "may", None)], "b": []})),
            (2, (0.5, (False, None), None)), (3, (None, None, {"a": None})), (4, None), (None, (1.0, (True, "why"), {}))]
    df = spark.createDataFrame(rows, f"k long, r {tx.RECORD}")
    memory = spark.createDataFrame([("yes", "ja"), ("why", "warum"), ("spec", "Angabe"), ("spec", "Angabe")], "text string, translated string").select(
        F.md5("text").alias("text_md5"), "translated")
    got = {r.k: r.r for r in tx.translate_records(df, ["k"], memory, "de").collect()}
    assert got[1].promising_result == (True, "ja") and got[1].total_score == 0.5 and got[1].requirement_matches["b"] == []
    assert got[1].requirement_matches["a"] == [((1, "warum"), ("must", "Angabe")), ((2, "Angabe"), ("may", None))]
    assert got[2].requirement_matches is None and got[2].promising_result == (False, None) and got[3].promising_result is None
    assert got[4] is None and got[None].promising_result.explanation == "warum" and len(got) == 5
    assert tx.translate_records(df, ["k"], memory, "en") is df
    left = tx.record_work_list(df, memory.where("translated <> 'ja'")).collect()
    assert [(r.text, r.n_records) for r in left] == [("yes", 1)]


def test_document_chain(spark):
    nb = " "
    pages = [(1, 2, "und der"), (1, 1, f" das{nb}ist "), (2, 1, "the and of"), (3, 1, "zzz"), (4, 1, "le la les")]
    df = spark.createDataFrame(pages, "d long, p int, t string")
    memory = spark.createDataFrame([("das ist\nund der", f"that{nb}is"), ("the and of", "no"), ("zzz", "no")], "text string, translated string").select(
        F.md5("text").alias("text_md5"), "translated")
    got = {r.d: (r.text, r.detected) for r in tx.document_texts(df, ["d"], "p", "t", memory).collect()}
    assert got == {1: ("that is", "de"), 2: ("the and of", "en"), 3: ("zzz", None), 4: ("le la les", "fr")}


def test_five_thousand_rules_equal_the_chain(spark):
    """One plan whatever the number of rules; later rules see what earlier ones wrote."""
    import random
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    rules = [(word(r.randrange(1, 5)), word(r.randrange(0, 4))) for _ in range(5000)]
    rules[10:10] = [("", "never"), ("\n", "\"\\"), ("\"\\", "[quote]")]
    texts = [word(400), "line\nline", "", None, "zzz", "a" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = tx.redact_by_rules(docs, "text", rules)
    assert len(out._jdf.queryExecution().logical().toString()) < 2_000_000
    for row in out.collect():
        text, hits = texts[row.id], []
        for i, (old, new) in enumerate(rules):
            if text is not None and old and old in text:
                hits.append((i, text.count(old)))
                text = text.replace(old, new)
        assert row.redacted == text and [tuple(h) for h in row.hits] == hits
    few = tx.redact(docs, "text", rules[:10])
    same = few.join(tx.redact_by_rules(docs, "text", rules[:10]).withColumnRenamed("redacted", "again"), "id")
    assert same.where(~F.col("redacted").eqNullSafe(F.col("again"))).count() == 0


def _chained(text, rules):
    hits = []
    for i, (old, new) in enumerate(rules):
        if text is not None and old and old in text:
            hits.append((i, text.count(old)))
            text = text.replace(old, new)
    return text, hits


@pytest.mark.parametrize("kind", ["words", "made", "signs", "scattered"])
def test_a_text_meets_only_the_rules_it_may_need(spark, monkeypatch, kind):
    """Pieces of a text and the search for rules change no row; a text with few of the rules' texts tries few."""
    import random
    r = random.Random(kind)
    word = lambda n, letters="aeinort": "".join(r.choice(letters) for _ in range(n))
    if kind == "signs":
        rules = [(word(r.randint(1, 3), "a.$\\[]é\U0001F600\u4e2d(|\t-^"), word(2, "XY$\\1")) for _ in range(60)]
    elif kind == "scattered":
        rules = [("".join(chr(r.randrange(0x4e00, 0x9fff)) for _ in range(2)), "#") for _ in range(300)]
    else:
        rules = [(w, f"[{word(4, 'eafb019')}]") for w in sorted({word(r.randint(3, 7)) for _ in range(400)})]
        rules += [("face", "x"), ("[face]", "made"), ("madex", "")] if kind == "made" else []
        rules[:0] = [("tone", "[face]")] if kind == "made" else []
    olds = [old for old, _ in rules]
    texts = [None, "", "zz zz", "QQQ", *[" ".join(r.choice(olds) + word(r.randrange(3), "aex") for _ in range(60)) for _ in range(30)], "".join(olds)]
    texts += [(t or "")[::-1] for t in texts] + ["tone " * 90 + "tonex"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for piece, depths in ((tx.PIECE, tx.RULE_DEPTHS), (5, (2, 1))):
        monkeypatch.setattr(tx, "PIECE", piece)
        monkeypatch.setattr(tx, "RULE_DEPTHS", depths)
        for row in tx.redact_by_rules(docs, "text", rules).collect():
            assert (row.redacted, [tuple(h) for h in row.hits]) == _chained(texts[row.id], rules)
    monkeypatch.undo()
    to_try, always = tx._rules_to_try(rules)
    tried = {x.id: x.k for x in docs.select("id", to_try(F.col("text")).alias("k")).collect()}
    assert len(tried[2]) == len(tried[3]) == always and (kind in ("made", "signs") or always < 9)
    assert all(k for i, k in tried.items() if any(old in (texts[i] or "") for old in olds))


def test_a_broken_character_stays(spark):
    docs = spark.range(1).select(F.expr("CAST(concat(CAST('tone ' AS BINARY), X'E282', CAST(' tone' AS BINARY)) AS STRING)").alias("text"))
    row = tx.redact_by_rules(docs, "text", [("tone", "T")]).select(F.hex("redacted").alias("h"), "hits").first()
    assert row.h == (b"T \xe2\x82 T").hex().upper() and [tuple(h) for h in row.hits] == [(0, 2)]


def test_no_rules_and_too_many(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x")], "id int, text string")
    assert [(r.redacted, r.hits) for r in tx.redact_by_rules(docs, "text", []).collect()] == [("x", [])]
    monkeypatch.setattr(tx, "MAX_RULE_BYTES", 3)
    with pytest.raises(ValueError):
        tx.redact_by_rules(docs, "text", [("ab", "cd")])


def test_rules_keep_the_order_of_files_and_lines(spark, tmp_dir, monkeypatch):
    want = []
    for f in range(3):
        lines = [f"{f}-{i}>{i}" for i in range(50)]
        want += [(f"{f}-{i}", str(i)) for i in range(50)]
        with open(f"{tmp_dir}/rules_{f}.txt", "w", newline="") as out:
            out.write("# head\r\n" + "\r\n".join(lines) + "\n\n")
    assert tx.load_rules(spark, tmp_dir) == want
    monkeypatch.setattr(tx, "MAX_RULE_BYTES", 100)
    with pytest.raises(ValueError):
        tx.load_rules(spark, tmp_dir)


def _labelled(spark):
    rows = [(1, "the thing that they thought", "en"), (2, "die dinge und das denken", "de"), (3, None, "en"), (4, "", "de"), (5, "xx", "nl"),
            (None, "the other thing", "en")]
    return spark.createDataFrame(rows, "id int, text string, lang string")


def test_language_profiles_equal_counting_by_hand(spark):
    import math
    from collections import Counter
    got = {r.gram: (r.w_de, r.w_en) for r in tx.learn_language_profiles(_labelled(spark), "id", languages=["de", "en"], grams=20).collect()}
    count = {lang: Counter() for lang in ("de", "en")}
    for r in _labelled(spark).collect():
        if r.lang in count:
            for w in (r.text or "").split():
                count[r.lang].update((" " + w + " ")[i:i + 3] for i in range(len(w)))
    both = count["de"] + count["en"]
    top = sorted(both, key=lambda g: (-both[g], g))[:20]
    share = lambda lang, g: math.floor(1000 * math.log((count[lang][g] + 1) / (sum(count[lang].values()) + 20)))
    assert got == {g: (share("de", g), share("en", g)) for g in top}


def test_language_by_grams(spark):
    profiles = spark.createDataFrame([(" th", -9, -2), (" di", -2, -9), (" a ", -5, -5)], "gram string, w_de long, w_en long")
    docs = spark.createDataFrame([(1, "This, the DIE"), (2, "die Dinge"), (3, "a"), (4, None), (5, ""), (6, "本"), (7, "the " * 50000)], "id int, text string")
    got = {r.id: (r.detected, r.hits) for r in tx.detect_language_by_grams(docs, "id", profiles).collect()}
    assert got == {1: ("en", 3), 2: ("de", 2), 3: ("de", 1), 7: ("en", 50000)}
    nothing = tx.learn_language_profiles(_labelled(spark).where("false"), "id")
    assert nothing.count() == 0 and tx.detect_language_by_grams(docs, "id", nothing).count() == 0


def test_profiles_are_learnt_from_a_bounded_sample(spark):
    many = spark.range(50).select(F.col("id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    few = tx.learn_language_profiles(many, "id", languages=["en"], documents=3, grams=1000)
    assert few.count() <= 3 * 4
    again = tx.learn_language_profiles(many.repartition(7), "id", languages=["en"], documents=3, grams=1000)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, again.collect()))


def test_profiles_are_learnt_without_shuffling_texts(spark, monkeypatch):
    """Ids are ranked without texts; rows of one id, and rows without an id, are picked as single rows."""
    rank = tx.rank_within

    def ids_only(df, *args, **options):
        assert df.columns == ["_id", "_lang"]
        return rank(df, *args, **options)
    monkeypatch.setattr(tx, "rank_within", ids_only)
    rows = [(i, "en", f"word{i}") for i in range(6)] + [(3, "en", "twice"), (None, "en", "null"), (None, "de", "null")]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    for n in (1, 2, 9):
        got = tx.learn_language_profiles(df, "doc_id", documents=n)
        assert got.columns == ["gram", "w_de", "w_en", "w_es", "w_fr"] and got.count() > 0
    assert {r.gram for r in tx.learn_language_profiles(df, "doc_id", documents=1).collect()} == {" nu", "nul", "ull", "ll "}
