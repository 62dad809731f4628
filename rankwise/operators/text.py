"""Text jobs: page assembly, normalisation, language tagging, translation
work list, redaction, link removal, pseudonyms, name checks.

All per-row work is built-in expressions (one projection, codegen); the
relational parts (language profiles, translation memory, name pools) are
joins against small dimension tables with a fixed, proven size.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.functions.columns import DEFAULT_TEXT_REPLACEMENTS, is_two_part_name, replace_chain, strip_unicode
from rankwise.functions.text import remove_links, tokens
from rankwise.operators.ranking import rank_within
from rankwise.session import checkpointed

# Small function-word profiles per language (our own lists).
LANGUAGE_PROFILES: dict[str, list[str]] = {
    "en": ["the", "and", "of", "to", "a", "in", "is", "it", "that", "with", "for", "as", "was", "on", "by",
           "this", "are", "be", "at", "or"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "sich", "auf", "für", "ein", "eine", "den", "zu",
           "von", "im", "dem", "auch", "es", "wie"],
    "fr": ["le", "la", "les", "et", "des", "du", "un", "une", "qui", "dans", "est", "pour", "que", "sur", "avec",
           "au", "aux", "ou", "par", "elle"],
    "es": ["el", "la", "los", "las", "y", "que", "del", "en", "por", "para", "con", "una", "es", "se", "al",
           "lo", "como", "su", "pero", "más"],
}


def assemble_pages(parts: DataFrame, key: Sequence[str], order_col: str, text_col: str,
                   out_col: str = "text") -> DataFrame:
    """Strip every page/paragraph and join them by newline in page order.

    One row per document: the pages of one document are one record's
    content, so gathering them is bounded by the document itself.
    """
    key = list(key)
    agg = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                                       strip_unicode(text_col).alias("t"))))
                                  .alias("_pages"))
    return agg.select(*key, F.array_join(F.transform("_pages", lambda p: p["t"]), "\n").alias(out_col))


def normalise_documents(docs: DataFrame, text_col: str = "text",
                        replacements: Sequence[tuple[str, str]] = DEFAULT_TEXT_REPLACEMENTS) -> DataFrame:
    """Ordered replacement chain (applied again after routing in the
    reference; the second pass is idempotent for the default pairs)."""
    return docs.withColumn(text_col, replace_chain(text_col, replacements))


def detect_language(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """X10 (re-aimed): tokens of the whole text that are function words of
    each language are counted in the row, without a shuffle; the language
    with most hits wins (ties: smaller code); no hit -> null (the caller
    treats it as an error)."""
    best = docs.select(id_col, language_of(text_col).alias("_b"))
    return best.select(id_col, F.col("_b.lang").alias("detected"), F.col("_b.hits").alias("hits"))


def language_of(text_col: str) -> Column:
    """``struct<hits, rank, lang>`` of a text, ``lang`` and ``hits`` null without a hit."""
    langs = sorted(LANGUAGE_PROFILES)
    known = sorted({w for words in LANGUAGE_PROFILES.values() for w in words})
    among = lambda words: lambda t: t.isin(words)

    def counted(words: Column) -> Column:
        return F.array_max(F.array(*[F.struct(F.size(F.filter(words, among(LANGUAGE_PROFILES[lang]))).cast("bigint").alias("hits"),
                                              F.lit(-i).alias("rank"), F.lit(lang).alias("lang")) for i, lang in enumerate(langs)]))
    found = F.transform(F.array(F.filter(tokens(text_col), among(known))), counted)
    best = F.filter(found, lambda b: b["hits"] > 0)
    return F.get(best, F.lit(0))


#: Character n-grams of a learnt profile: how many it keeps, and how many labelled documents of a language it is learnt from.
PROFILE_GRAMS, PROFILE_DOCUMENTS = 4000, 100


def character_grams(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keep..., gram``: the three-character pieces of every word of the whole text, a blank at both ends of a word."""
    words = docs.select(*keep, F.explode(tokens(text_col)).alias("_word"))
    padded = words.withColumn("_word", F.concat(F.lit(" "), "_word", F.lit(" ")))
    return padded.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("_word") - 2), lambda i: F.substr("_word", i, F.lit(3)))).alias("gram"))


def learn_language_profiles(labelled: DataFrame, id_col: str, lang_col: str = "lang", text_col: str = "text",
                            languages: Sequence[str] = tuple(sorted(LANGUAGE_PROFILES)), documents: int = PROFILE_DOCUMENTS,
                            grams: int = PROFILE_GRAMS) -> DataFrame:
    """Character n-gram profiles out of labelled documents: ``gram, w_<language>...``, ``grams`` rows at most.

    Learnt from whole texts of at most ``documents`` documents a language (those of least hashed id).  A weight is the
    logarithm of a gram's smoothed share in the language, in thousandths rounded down: whole numbers, whose sums
    don't depend on their order.  The most frequent grams are kept (ties: the smaller gram).
    """
    languages = list(languages)
    known = labelled.where(F.col(lang_col).isin(languages)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    order = [F.md5(F.col("_id").cast("string")), F.col("_id")]
    # ids are ranked without their texts, and meet the texts again when few are left; an id may have several rows
    ids = rank_within(known.select("_id", "_lang"), ["_lang"], order, name="_r").where(F.col("_r") <= documents)
    ids = ids.select(F.col("_id").alias("_pick"), F.col("_lang").alias("_of")).distinct()
    found = known.join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_pick")) & (F.col("_lang") == F.col("_of")), "left_semi")
    least = found.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy(*order))).where(F.col("_r") <= documents)
    per = [F.count_if(F.col("_lang") == lang).alias(f"c_{lang}") for lang in languages]
    counts = checkpointed(character_grams(least, ["_lang"], "_text").groupBy("gram").agg(F.count(F.lit(1)).alias("_all"), *per))
    totals = counts.agg(*[F.coalesce(F.sum(f"c_{lang}"), F.lit(0)).alias(lang) for lang in languages]).first()
    top = counts.orderBy(F.desc("_all"), "gram").limit(grams)
    return checkpointed(top.select("gram", *[F.floor(1000 * F.log((F.col(f"c_{lang}") + 1.0) / F.lit(float(totals[lang] + grams)))).cast("bigint")
                                             .alias(f"w_{lang}") for lang in languages]))


def detect_language_by_grams(docs: DataFrame, id_col: str, profiles: DataFrame, text_col: str = "text") -> DataFrame:
    """The language under whose profile a text is likeliest: ``id, detected, hits`` (grams of the text that the profiles hold).

    Grams meet the profiles (a bounded table, broadcast) in the document's own task and are summed there; one row a
    document is shuffled.  Ties go to the smaller code; a text without a known gram (null, empty, another script)
    has no language and no row.  Rows of equal id count as one document.
    """
    languages = sorted(c[2:] for c in profiles.columns if c.startswith("w_"))
    hits = character_grams(docs, [id_col], text_col).join(F.broadcast(profiles), "gram")
    sums = hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("hits"), *[F.sum(f"w_{lang}").alias(f"w_{lang}") for lang in languages])
    best = F.array_max(F.array(*[F.struct(F.col(f"w_{lang}").alias("w"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(languages)]))
    return sums.select(id_col, best["lang"].alias("detected"), "hits")


def translation_work_list(docs: DataFrame, text_col: str, lang_col: str, memory: DataFrame | None,
                          working_language: str = "en") -> DataFrame:
    """X11 (re-aimed): distinct texts not in the working language, minus the
    ones already in the translation memory ``(text_md5, translated)``."""
    todo = (docs.filter(F.col(lang_col) != working_language)
            .select(F.md5(text_col).alias("text_md5"), F.col(lang_col).alias("lang"))
            .groupBy("text_md5", "lang").agg(F.count(F.lit(1)).alias("n_docs")))
    if memory is not None:
        todo = todo.join(memory.select("text_md5"), "text_md5", "left_anti")
    return todo


def apply_translations(docs: DataFrame, text_col: str, memory: DataFrame) -> DataFrame:
    """X11: left join to the memory; untranslated texts stay as they are."""
    m = memory.select("text_md5", "translated")
    return (docs.withColumn("text_md5", F.md5(text_col)).join(m, "text_md5", "left")
            .withColumn(text_col, F.coalesce("translated", text_col)).drop("translated", "text_md5"))


#: A match record as the record sink writes it, and the fields of it that are shown to people.
RECORD = ("struct<total_score: double, promising_result: struct<promising: boolean, explanation: string>, requirement_matches: "
          "map<string, array<struct<score: struct<value: int, explanation: string>, requirement: struct<type: string, specification: string>>>>>")
#: Copies of the memory, so that a text which every record holds is joined by several tasks.
MEMORY_SALTS = 16


def record_texts(record: str = "r") -> Column:
    """X11: all texts of a record's output fields (explanation of the decision, specification and explanation of each
    match), distinct and without nulls."""
    matches = F.flatten(F.coalesce(F.map_values(f"{record}.requirement_matches"), F.array()))
    each = F.flatten(F.transform(matches, lambda m: F.array(m["requirement"]["specification"], m["score"]["explanation"])))
    return F.filter(F.array_distinct(F.concat(F.array(f"{record}.promising_result.explanation"), each)), lambda t: t.isNotNull())


def record_work_list(records: DataFrame, memory: DataFrame | None, record: str = "r") -> DataFrame:
    """X11: distinct texts of the records (``text_md5, text, n_records``) that the memory doesn't hold."""
    found = records.select(F.explode(record_texts(record)).alias("text")).groupBy(F.md5("text").alias("text_md5")).agg(
        F.min("text").alias("text"), F.count(F.lit(1)).alias("n_records"))
    return found if memory is None else found.join(memory.select("text_md5"), "text_md5", "left_anti")


def translate_records(records: DataFrame, keys: Sequence[str], memory: DataFrame, output_language: str,
                      native_language: str = "en", record: str = "r") -> DataFrame:
    """X11: the three output fields of nested match records (``RECORD``) out of a memory ``(text_md5, translated)``.

    Each record's distinct texts leave it, are joined to the memory, and come
    back as one map a record, by which the nested arrays are rewritten in
    place, position by position.  Texts that the memory doesn't hold stay; in
    the native language nothing is done.  ``keys`` name a record.
    """
    if output_language == native_language:
        return records
    keys = list(keys)
    texts = records.select(*keys, F.explode(record_texts(record)).alias("_text")).withColumn("_md5", F.md5("_text"))
    texts = texts.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(MEMORY_SALTS)).cast("int"))
    known = memory.groupBy("text_md5").agg(F.min("translated").alias("_new")).select(
        F.col("text_md5").alias("_md5"), "_new", F.explode(F.sequence(F.lit(0), F.lit(MEMORY_SALTS - 1))).alias("_salt"))
    found = texts.join(known, ["_md5", "_salt"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_text", "_new"))).alias("_map"))
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    found = found.withColumnsRenamed(names)
    same = [records[k].eqNullSafe(found[n]) for k, n in names.items()]
    out = records.join(found, same, "left").drop(*names.values())
    new = lambda t: F.coalesce(F.try_element_at("_map", t), t)
    decision = F.col(f"{record}.promising_result")
    matches = F.transform_values(f"{record}.requirement_matches", lambda _, ms: F.transform(ms, lambda m: F.struct(
        F.struct(m["score"]["value"].alias("value"), new(m["score"]["explanation"]).alias("explanation")).alias("score"),
        F.struct(m["requirement"]["type"].alias("type"), new(m["requirement"]["specification"]).alias("specification")).alias("requirement"))))
    whole = F.struct(F.col(f"{record}.total_score").alias("total_score"),
                     F.when(decision.isNotNull(), F.struct(decision["promising"].alias("promising"), new(decision["explanation"]).alias("explanation")))
                     .alias("promising_result"), matches.alias("requirement_matches"))
    return out.withColumn(record, F.when(F.col(record).isNotNull(), whole)).drop("_map")


def document_texts(pages: DataFrame, key: Sequence[str], order_col: str, text_col: str, memory: DataFrame,
                   working_language: str = "en", replacements: Sequence[tuple[str, str]] = DEFAULT_TEXT_REPLACEMENTS) -> DataFrame:
    """X9 as one chain: pages to a text (X7), replacements (X8), language (X10), other languages through the memory
    (X11), replacements again.  Returns ``key..., text, detected``; a text of unknown language stays as it is.

    The language is a column of the same row, so that the routed branch needs no
    join of the documents with themselves; only texts to translate look for a
    key in the memory.
    """
    docs = normalise_documents(assemble_pages(pages, key, order_col, text_col), "text", replacements)
    docs = docs.withColumn("detected", language_of("text")["lang"])
    foreign = F.when(F.col("detected") != working_language, F.md5("text"))
    known = memory.groupBy(F.col("text_md5").alias("_md5")).agg(F.min("translated").alias("_new"))
    routed = docs.withColumn("_md5", foreign).join(known, "_md5", "left").withColumn("text", F.coalesce("_new", "text"))
    return normalise_documents(routed, "text", replacements).select(*key, "text", "detected")


def parse_rules(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``old>new`` lines, ``#`` comments and blank lines skipped; a line
    without exactly two parts gets ``reason = 'bad_rule'``."""
    body = lines.filter(~F.col(line_col).startswith("#") & (F.length(F.trim(line_col)) > 0))
    parts = F.split(F.col(line_col), ">")
    return body.select(F.col("rule_no") if "rule_no" in lines.columns else F.monotonically_increasing_id()
                       .alias("rule_no"),
                       F.get(parts, 0).alias("old"), F.get(parts, 1).alias("new"),
                       F.when(F.size(parts) != 2, F.lit("bad_rule")).alias("reason"))


#: Bytes of rules that one job takes: they travel with the plan as one constant.
MAX_RULE_BYTES = 16 << 20


def load_rules(spark, path: str, strict: bool = True) -> list[tuple[str, str]]:
    """Replacement rules (``old>new`` lines) of a file or a folder, files by path and lines as they stand.

    A rule file is configuration; rules of more than ``MAX_RULE_BYTES`` in all
    are an error, found before anything is read to the driver.  A malformed
    line is an error in strict mode and skipped otherwise."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    size = whole.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of replacement rules, at most {MAX_RULE_BYTES} are taken")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    rules = parse_rules(lines.withColumn("rule_no", F.struct("file", "line"))).orderBy("rule_no").collect()
    bad = [r for r in rules if r["reason"] is not None]
    if bad and strict:
        raise ValueError(f"{len(bad)} malformed replacement rule(s), first: {bad[0]['old']!r}")
    return [(r["old"], r["new"]) for r in rules if r["reason"] is None]


def redact(docs: DataFrame, text_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Literal, case-sensitive replacements in order over every text,
    plus per-rule hit counts (non-overlapping, on the text as it is when the
    rule applies).  ``rules`` is a short, bounded list (configuration)."""
    cur = F.col(text_col)
    hits = []
    for i, (old, new) in enumerate(rules):
        hits.append(((F.length(cur) - F.length(F.replace(cur, F.lit(old), F.lit("")))) / F.lit(len(old)))
                    .cast("bigint").alias(f"hits_{i}"))
        cur = F.replace(cur, F.lit(old), F.lit(new))
    return docs.select("*", cur.alias("redacted"), *hits)


#: Characters of a rule by which its places are looked for (the first depth whose tree is small enough counts), and nodes of that tree.
RULE_DEPTHS, RULE_NODES = (16, 8, 6, 4, 3, 2, 1), 50_000


def _rule_tree(olds: Sequence[str], depth: int, most: float) -> dict | None:
    """The first ``depth`` characters of the rules as a tree of dicts (key "" where one ends), if it has at most ``most`` nodes."""
    root: dict = {}
    n = 0
    for old in olds:
        at = root
        for c in old[:depth]:
            n += c not in at
            at = at.setdefault(c, {})
        at[""] = {}
        if n > most:
            return None
    return root


def _plain(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _tree_pattern(node: dict) -> str:
    """A regular expression for the longest way down the tree."""
    last = "".join(_plain(c) for c, x in node.items() if c and not any(x))
    ways = [_plain(c) + _tree_pattern(x) for c, x in node.items() if c and any(x)] + ([f"[{last}]" if len(last) > 1 else last] if last else [])
    if not ways:
        return ""
    return (ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})") + ("?" if "" in node else "")


def _character_class(text: str) -> str:
    """A regular expression for the characters of the text, as ranges (few, so that some may hold more)."""
    codes = sorted(set(map(ord, text)))
    cuts = sorted(sorted(range(1, len(codes)), key=lambda i: codes[i] - codes[i - 1])[-15:])
    return "[" + "".join(f"\\x{{{codes[i]:x}}}-\\x{{{codes[j - 1]:x}}}" for i, j in zip([0, *cuts], [*cuts, len(codes)], strict=True)) + "]"


def _made_by_rules(rules: Sequence[tuple[str, str]]) -> list[int]:
    """Rules whose text may come about by what rules write: it holds an end of a written text, or begins inside one."""
    news = {new for _, new in rules}
    ends = {c for new in news for c in new[:1] + new[-1:]}
    inside = {new[i:i + k] for new in news for k in range(1, 5) for i in range(len(new) - k + 1)}
    return [i for i, (old, _) in enumerate(rules) if ("" in news and len(old) > 1) or old[:4] in inside or not ends.isdisjoint(old)]


def _rules_to_try(rules: Sequence[tuple[str, str]]) -> tuple[Callable[[Column], Column], int]:
    """What gives the numbers of the rules whose text may occur in a text when their turn comes, in order; how many
    of them are tried with every text.

    One search through the text finds, at each of its positions, the longest
    beginning of a rule; a table by that beginning's checksum has the rules
    that begin so.  Rules whose text may come about later are always tried.
    """
    always = _made_by_rules(rules)
    listed = F.from_json(F.lit(json.dumps(always)), "array<int>")
    searched = sorted(set(range(len(rules))) - set(always))
    if not searched:
        return lambda _: listed, len(always)
    olds = [rules[i][0] for i in searched]
    depth, tree = next((d, t) for d in RULE_DEPTHS if (t := _rule_tree(olds, d, RULE_NODES if d > 1 else math.inf)) is not None)
    begun: dict[str, list[int]] = {}
    for i, old in zip(searched, olds, strict=True):
        begun.setdefault(old[:depth], []).append(i)
    size = 2 * len(begun)
    rows: list[list] = [[] for _ in range(size)]
    for piece in begun:
        found = [i for k in range(1, len(piece) + 1) for i in begun.get(piece[:k], [])]
        rows[zlib.crc32(piece.encode()) % size].append({"p": piece, "r": found})
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<struct<p: string, r: array<int>>>>")
    head = f"(?={_character_class(''.join(begun))}{{{min(map(len, begun))}}})"  # most positions fail by that
    pattern = F.lit(f"{head}(?=({_tree_pattern(tree)}))")

    def row(piece: Column) -> Column:
        same = F.filter(F.get(table, (F.crc32(piece) % size).cast("int")), lambda e: e["p"] == piece)
        return F.coalesce(F.get(same, F.lit(0))["r"], F.array().cast("array<int>"))

    def to_try(text: Column) -> Column:
        found = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1))), row))
        return F.sort_array(F.array_union(found, listed) if always else F.array_distinct(found))
    return to_try, len(always)


#: Characters of a piece of text at least, and of it for each rule that every piece is tried with.
PIECE, PIECE_A_RULE = 64, 8


def _text_pieces(text: Column, rules: Sequence[tuple[str, str]], least: int) -> Column:
    """The text cut where no rule's text can lie across: a piece is ``least`` characters and what follows of characters
    that rules replace (or of a few ranges with all of them).  Other characters stay as they are whatever is replaced."""
    some = _character_class("".join(old for old, _ in rules))
    whole = F.when(text.isNotNull(), F.array(text))
    return F.when(F.is_valid_utf8(text), F.regexp_extract_all(text, F.lit(f"(?s).{{{least}}}{some}*+|.+"), F.lit(0))).otherwise(whole)


def _hits_by_rule(hits: Column) -> Column:
    """Sums of ``(rule_no, n)`` by rule, in order."""
    one = lambda acc: F.array(F.struct(acc["rule_no"].alias("rule_no"), acc["n"].alias("n")))
    state = "struct<done: array<struct<rule_no: int, n: bigint>>, rule_no: int, n: bigint>"

    def step(acc: Column, hit: Column) -> Column:
        same = F.struct(acc["done"].alias("done"), acc["rule_no"].alias("rule_no"), (acc["n"] + hit["n"]).alias("n"))
        other = F.struct(F.concat(acc["done"], one(acc)).alias("done"), hit["rule_no"].alias("rule_no"), hit["n"].alias("n"))
        return F.when(acc["rule_no"] == hit["rule_no"], same.cast(state)).otherwise(other.cast(state))
    start = F.struct(F.array().alias("done"), F.lit(-1).alias("rule_no"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(F.sort_array(hits), start, step, lambda acc: F.filter(F.concat(acc["done"], one(acc)), lambda h: h["rule_no"] >= 0))


def redact_by_rules(docs: DataFrame, text_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """X18 for rule lists of any length: the rules are data, one constant array that a fold goes through, so that the
    plan doesn't grow with them.

    A text is cut into pieces that no rule's text lies across, and a piece goes
    through the rules whose beginning it holds and those whose text other rules
    may write (``_rules_to_try``); each is tried only where its text occurs at
    that point (a plain search).  Adds ``redacted`` and ``hits``, an array of
    ``(rule_no, n)`` in order, of the rules that occur: non-overlapping places
    in the text as it is when the rule applies.  A rule with an empty left side
    does nothing; a null text stays null and has no hits.  Rules of more than
    ``MAX_RULE_BYTES`` are an error.
    """
    size = sum(len(old.encode()) + len(new.encode()) for old, new in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of replacement rules, at most {MAX_RULE_BYTES} are taken")
    used = [(i, old, new) for i, (old, new) in enumerate(rules) if old]
    hits_type = "array<struct<rule_no: int, n: bigint>>"
    text = F.col(text_col).cast("string")
    if not used:
        return docs.select("*", text.alias("redacted"), F.array().cast(hits_type).alias("hits"))
    listed = json.dumps([{"rule_no": i, "old": old, "new": new} for i, old, new in used])
    table = F.from_json(F.lit(listed), "array<struct<rule_no: int, old: string, new: string>>")
    state = f"struct<t: string, hits: {hits_type}>"

    def step(acc: Column, rule: Column) -> Column:
        t, old = acc["t"], rule["old"]
        n = ((F.octet_length(t) - F.octet_length(F.replace(t, old, F.lit("")))) / F.octet_length(old)).cast("bigint")
        hit = F.array(F.struct(rule["rule_no"].alias("rule_no"), n.alias("n")))
        after = F.struct(F.replace(t, old, rule["new"]).alias("t"), F.concat(acc["hits"], hit).alias("hits")).cast(state)
        return F.when(F.contains(t, old), after).otherwise(acc)

    def redacted(piece: Column) -> Column:
        start = F.struct(piece.alias("t"), F.array().alias("hits")).cast(state)
        return F.aggregate(F.transform(to_try(piece), lambda i: F.get(table, i)), start, step)
    plain = [r[1:] for r in used]
    to_try, always = _rules_to_try(plain)
    pieces = _text_pieces(text, plain, max(PIECE, PIECE_A_RULE * always))
    folded = docs.withColumn("_folded", F.transform(pieces, redacted))
    hits = F.coalesce(_hits_by_rule(F.flatten("_folded.hits")), F.array().cast(hits_type))
    return folded.select(*docs.columns, F.array_join("_folded.t", "").alias("redacted"), hits.alias("hits"))


def strip_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Anchors replaced by their visible text, bare URLs removed."""
    return pages.withColumn(html_col, remove_links(html_col))


def pseudonyms(ids: DataFrame, id_col: str, forenames: DataFrame, surnames: DataFrame,
               seed: int | None = None) -> DataFrame:
    """X20 (re-aimed): a distinct ``Forename Surname`` per id, reproducible.

    Ids are ranked (by ``xxhash64(id, seed)`` or by id) with the exact
    distributed ranking; rank r maps to forename ``r // S`` and surname
    ``r % S`` (S = number of surnames) - two equi joins with the small name
    tables, no cross product.  Only one-word names enter the pools.  Beyond
    F x S ids the names go round again with a number on the surname
    (``Ann Poe``, ``Ann Poe-2``), so every id has a name of its own.
    """
    one_word = lambda df, name: (df.select(F.col(df.columns[0]).alias(name))
                                 .filter((F.length(name) > 0) & ~F.col(name).rlike(r"\s")).distinct())
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)] if seed is not None else [F.col(id_col)]
    ranked = rank_within(ids.select(id_col).distinct(), [], order, name="_r")
    fn = rank_within(one_word(forenames, "forename"), [], ["forename"], name="_fi")
    sn = rank_within(one_word(surnames, "surname"), [], ["surname"], name="_si")
    n_f, n_s = (p.agg(F.count(F.lit(1))).first()[0] for p in (fn, sn))
    if not n_f or not n_s:
        raise ValueError("a name pool has no one-word name")
    keyed = ranked.select(id_col, F.expr(f"((_r - 1) div {n_s}) % {n_f} + 1").alias("_fi"),
                          F.expr(f"(_r - 1) % {n_s} + 1").alias("_si"), F.expr(f"(_r - 1) div {n_s * n_f} + 1").alias("_round"))
    out = keyed.join(fn, "_fi").join(sn, "_si")
    again = F.when(F.col("_round") > 1, F.concat(F.lit("-"), F.col("_round").cast("string"))).otherwise("")
    return out.select(id_col, F.concat("forename", F.lit(" "), "surname", again).alias("name"))


def name_checks(names: DataFrame, name_col: str = "name") -> DataFrame:
    """P5: exactly two blank-separated parts, no stray blanks."""
    return names.withColumn("valid_name", F.coalesce(is_two_part_name(name_col), F.lit(False)))
