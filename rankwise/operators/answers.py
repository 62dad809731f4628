"""Answers from a scorer: JSON out of noisy text, lax validation, reject table.

Everything is parsed **as strings** and validated with expressions, so a
bad answer becomes a row in a reject table with a reason instead of a
silent null (``from_json`` hides failures) or a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwise.functions.columns import strip_unicode

JSON_OPTIONS = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE",
                "columnNameOfCorruptRecord": "_corrupt"}

# String spellings accepted as booleans in lax mode.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "f", "false", "n", "no", "off"]

# possessive and unrolled: Java's matcher must not go one call deeper for each character of a long text;
# an unclosed literal goes to the end, so that none of its quotes is tried as a beginning again
_STRING_LITERAL = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z|\\\z)'


def json_object_text(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty string when absent."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def single_object(obj: Column) -> Column:
    """True when the braces outside string literals close exactly once, at the
    end (``{..} {..}`` and ``{..} }`` are rejected like a strict parser would)."""
    bare = F.regexp_replace(obj, _STRING_LITERAL, '""')
    braces = F.regexp_replace(bare, r"[^{}]", "")
    depths = F.aggregate(
        F.split(braces, ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("closed")),
        lambda acc, ch: F.struct(
            (acc["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("d"),
            (acc["closed"] + F.when((ch == "}") & (acc["d"] == 1), 1).otherwise(0)).alias("closed")))
    return (F.length(braces) > 0) & (depths["d"] == 0) & (depths["closed"] == 1)


def _kind(v: Column) -> Column:
    """JSON type of a variant: ``BIGINT``, ``DECIMAL``, ``STRING``, ``BOOLEAN``, ``VOID`` ..., null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column) -> Column:
    return v.try_cast("string")


_NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]


def lax_int(v: Column) -> Column:
    """``85`` / ``"85"`` / ``85.0`` -> 85, ``true`` -> 1; ``85.5``, words, lists -> null."""
    t = F.trim(_text(v))
    number = F.when(t.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", "").try_cast("bigint"))
    whole = F.when(v.try_cast("double") == F.floor(v.try_cast("double")), v.try_cast("bigint"))  # 1e2
    return (F.when(_kind(v) == "BOOLEAN", F.when(t == "true", 1).otherwise(0).cast("bigint"))
            .when(_kind(v).isin(["DOUBLE", "FLOAT"]), whole)
            .when(_kind(v).isin([*_NUMBERS, "STRING"]), number))


def lax_bool(v: Column) -> Column:
    """Booleans, their spellings (any case), and the numbers 1 and 0; else null."""
    t = F.lower(F.trim(_text(v)))
    words = F.when(t.isin(TRUE_WORDS), F.lit(True)).when(t.isin(FALSE_WORDS), F.lit(False))
    n = v.try_cast("double")
    return (F.when(_kind(v).isin(["BOOLEAN", "STRING"]), words)
            .when(_kind(v).isin(_NUMBERS), F.when(n == 1, F.lit(True)).when(n == 0, F.lit(False))))


def strict_text(v: Column) -> Column:
    """A JSON string, stripped; numbers, lists and objects are no text."""
    return F.when(_kind(v) == "STRING", strip_unicode(_text(v)))


_FIELD = {"int": lax_int, "bool": lax_bool, "str": strict_text}


def parse_answers(answers: DataFrame, text_col: str, fields: dict[str, str]) -> DataFrame:
    """Parse ``text_col`` into the declared fields (``int`` / ``bool`` / ``str``).

    Fields are read as variants, so that the JSON type of a value is known.

    Adds the typed fields plus ``reason`` (null when the answer is valid):
    ``no_json``, ``not_one_object``, ``malformed``, ``missing_<f>``,
    ``bad_<f>``.  Split with ``valid_answers`` / ``rejected_answers``.
    """
    schema = T.StructType([T.StructField(f, T.VariantType()) for f in fields]
                          + [T.StructField("_corrupt", T.StringType())])
    obj = F.coalesce(json_object_text(F.col(text_col)), F.lit(""))
    df = (answers.withColumn("_obj", obj)
          .withColumn("_one", single_object(F.col("_obj")))
          .withColumn("_p", F.when(F.length("_obj") > 0, F.from_json(F.col("_obj"), schema, JSON_OPTIONS))))
    typed, checks = [], [
        (F.length("_obj") == 0, "no_json"),
        (~F.col("_one"), "not_one_object"),
        (F.col("_p._corrupt").isNotNull() | F.col("_p").isNull(), "malformed"),
    ]
    for f, kind in fields.items():
        raw = F.col(f"_p.{f}")
        val = _FIELD[kind](raw)
        typed.append(val.alias(f))
        checks.append((raw.isNull(), f"missing_{f}"))
        checks.append((val.isNull(), f"bad_{f}"))
    reason = F.lit(None).cast("string")
    for cond, label in reversed(checks):
        reason = F.when(cond, F.lit(label)).otherwise(reason)
    return df.select(*answers.columns, *typed, reason.alias("reason"))


def valid_answers(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def rejected_answers(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())


def raise_on_reject(parsed: DataFrame) -> DataFrame:
    """Strict mode: the query fails at run time on the first invalid answer."""
    return parsed.withColumn("reason", F.when(F.assert_true(F.col("reason").isNull(),
                                                            F.lit("invalid answer")).isNull(), F.col("reason")))


# ----------------------------------------------------------- requirements

REQUIREMENT_ITEM = T.StructType([T.StructField("type", T.VariantType()),
                                 T.StructField("specification", T.VariantType()),
                                 T.StructField("_corrupt", T.StringType())])


def parse_requirements(answers: DataFrame, text_col: str, types: DataFrame,
                       kinds: Sequence[str] = ("mandatory", "optional")) -> DataFrame:
    """P2 + J9: extraction answer ``{type: [{type, specification}, ...]}`` ->
    one row per requirement ``(... , req_type, req_pos, kind, specification, reason)``.

    An answer that is not one JSON object keeps one row with the reason
    (``no_json``, ``not_one_object``, ``malformed``) and null fields.  Unknown
    types (join to the dimension, one row a type), values that are not lists and
    list items that are not objects are dropped; an object with a bad field
    keeps a ``reason`` - use ``raise_on_reject`` for the strict behaviour.
    """
    keys = [c for c in answers.columns if c != text_col]
    entry = T.MapType(T.StringType(), T.StringType())
    base = (answers.select(*keys, json_object_text(F.col(text_col)).alias("_obj"))
            .withColumn("_m", F.when(F.length("_obj") > 0, F.from_json(F.col("_obj"), entry, JSON_OPTIONS)))
            .withColumn("reason", F.when(F.length("_obj") == 0, "no_json").when(F.col("_obj").isNull(), "no_json")
                        .when(~single_object(F.col("_obj")), "not_one_object").when(F.col("_m").isNull(), "malformed")))
    # one pass: an answer with a reason keeps one row of nulls through both explodes
    entries = base.select(*keys, "reason", F.explode_outer(F.when(F.col("reason").isNull(), F.col("_m"))).alias("req_type", "_val"))
    known = types.select(F.col("type").alias("req_type"), F.lit(True).alias("_known"))
    entries = entries.join(known, "req_type", "left").filter(F.col("reason").isNotNull() | F.col("_known"))
    listed = F.when(F.trim("_val").startswith("["), F.from_json("_val", T.ArrayType(T.StringType()), JSON_OPTIONS))
    items = entries.select(*keys, "req_type", F.col("reason").alias("_whole"), F.posexplode_outer(listed).alias("req_pos", "_item"))
    objs = items.filter(F.col("_whole").isNotNull() | F.trim("_item").startswith("{"))
    parsed = (objs.withColumn("_r", F.from_json("_item", REQUIREMENT_ITEM, JSON_OPTIONS))
              .withColumns({"_type": strict_text(F.col("_r.type")), "_spec": strict_text(F.col("_r.specification"))}))
    kind, spec = F.col("_type"), F.col("_spec")
    reason = (F.when(F.col("_whole").isNotNull(), F.col("_whole"))
              .when(F.col("_r._corrupt").isNotNull(), F.lit("malformed"))
              .when(F.col("_r.type").isNull(), F.lit("missing_type"))
              .when(F.coalesce(~kind.isin(list(kinds)), F.lit(True)), F.lit("bad_type"))
              .when(F.col("_r.specification").isNull(), F.lit("missing_specification"))
              .when(spec.isNull(), F.lit("bad_specification")))
    return parsed.select(*keys, "req_type", "req_pos", kind.alias("kind"), spec.alias("specification"), reason.alias("reason"))


# ------------------------------------------------------------- answer step

def answer(requests: DataFrame, key_cols: Sequence[str],
           scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """X21 + J3: run ``scorer`` once per **distinct** input and join the
    answers back to every request on the key (never by position).

    ``scorer`` maps a frame of distinct ``key_cols`` to the same keys plus an
    ``answer`` column; it may be a built-in expression, a join (the native
    scorer) or a ``mapInPandas`` call to an outside service.
    """
    keys = list(key_cols)
    distinct = requests.select(*keys).distinct()
    answers = scorer(distinct)
    return requests.join(answers.select(*keys, "answer"), keys, "left")


def pandas_scorer(fn: Callable, input_col: str, parallelism: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Wrap a caller's pandas function (``Series`` of inputs -> ``Series``
    of answer texts), e.g. a client for an outside judge, as a scorer for
    ``answer``.  Arrow batches through ``mapInPandas``; ``parallelism``
    repartitions first to bound the number of concurrent callers."""

    def scorer(keys: DataFrame) -> DataFrame:
        df = keys if parallelism is None else keys.repartition(parallelism)
        schema = T.StructType(df.schema.fields + [T.StructField("answer", T.StringType())])

        def run(batches):
            for pdf in batches:
                out = pdf.copy()
                out["answer"] = fn(pdf[input_col]).astype(str)
                yield out

        return df.mapInPandas(run, schema)

    return scorer


#: Rows of an answer table: what was asked by hash, the answer or why there is none, how often the caller was tried.
ANSWER_TABLE = "request_key string, answer string, reason string, tries int, run int"


def judge(requests: DataFrame, input_col: str, fn: Callable, store: str, *, callers: int = 8, tries: int = 3) -> DataFrame:
    """E1 with a memory: every distinct request is asked once, whatever number of runs share ``store``.

    ``store`` is a folder of answers keyed by the hash of the request.  A run
    asks only requests without an answer there (an anti join), at most
    ``callers`` at a time, in Arrow batches of the caller's ``fn`` (``Series``
    of texts -> sequence of answers).  A batch that fails is asked text by
    text, each at most ``tries`` times; what still fails, and a null answer,
    is a row with a ``reason`` and is asked again by the next run.  Answers
    are written before they are joined back, so that a lost executor
    or a second action never asks again what was written.

    Returns the requests with ``answer, reason, run`` (the number of the run
    that got the answer); a null request is an empty text.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], ANSWER_TABLE).write.mode("ignore").parquet(store)
    keyed = requests.withColumn("request_key", F.sha2(F.coalesce(F.col(input_col), F.lit("")), 256))
    known = spark.read.schema(ANSWER_TABLE).parquet(store)
    run = known.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] + 1
    todo = (keyed.groupBy("request_key").agg(F.coalesce(F.min(input_col), F.lit("")).alias("_input"))
            .join(known.where("reason is null").select("request_key"), "request_key", "left_anti"))

    def ask(batches):
        for rows in batches:
            out = rows[["request_key"]].copy()
            out["answer"], out["reason"], out["tries"] = _asked(fn, rows["_input"], tries)
            out["run"] = run
            yield out

    todo.repartition(callers).mapInPandas(ask, ANSWER_TABLE).write.mode("append").parquet(store)
    best = F.struct((F.col("reason").isNull()).alias("ok"), "run", "answer", "reason")
    got = spark.read.schema(ANSWER_TABLE).parquet(store).groupBy("request_key").agg(F.max(best).alias("_got"))
    return (keyed.join(got, "request_key", "left")
            .select(*requests.columns, *[F.col(f"_got.{c}").alias(c) for c in ("answer", "reason", "run")]))


def _asked(fn: Callable, texts, tries: int) -> tuple[list, list, list]:
    """Answers, reasons and tries of one batch."""
    try:
        answers = list(fn(texts))
        if len(answers) == len(texts):
            return [None if a is None else str(a) for a in answers], ["no_answer" if a is None else None for a in answers], [1] * len(answers)
    except Exception:  # noqa: BLE001 - the caller's code; each text gets its own turn below
        pass
    out = [], [], []
    for i in range(len(texts)):
        answer, reason, n = None, None, 0
        while answer is None and n < tries:
            n += 1
            try:
                answer, reason = next(iter(fn(texts.iloc[i:i + 1]))), "no_answer"
            except Exception as failed:  # noqa: BLE001
                reason = f"failed: {type(failed).__name__}"
        for column, value in zip(out, (None if answer is None else str(answer), None if answer is not None else reason, n), strict=True):
            column.append(value)
    return out
