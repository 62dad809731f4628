"""The pipeline's stages against brute force, each on its predecessor's rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from rankwise.llm import bpe, mixing, toxicity
from tests.llm.helpers import SF, edge_documents, frame, roots, windows_removed
from tests.llm.test_dedup import _fingerprint
from tests.llm.test_native import _targets

STAGES = dict(corpus_pipeline.STAGES)


def _rows(df):
    assert df.columns[:5] == corpus_pipeline.COLUMNS
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Each stage's input and output over the small table."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_and_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "bpe"]
    assert all(t.columns == corpus_pipeline.COLUMNS for t in tables[:-1])


def test_toxic_documents_go(spark, tables):
    judged = toxicity.digest(tables[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert Counter(i for i, _ in _rows(tables[1])) == Counter(r.doc_id for r in judged if not r.predicted)
    assert set(map(tuple, tables[1].collect())) <= set(map(tuple, tables[0].collect()))


def _one_of_each_group(rows):
    fp = [_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    root = roots(len(fp), *zip(*pairs, strict=True)) if pairs else range(len(fp))
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter(least.get(r) for r in set(root))


def test_one_of_each_group_stays(tables):
    assert Counter(i for i, _ in _rows(tables[2])) == _one_of_each_group(_rows(tables[1]))
    assert set(map(tuple, tables[2].collect())) <= set(map(tuple, tables[1].collect()))


def test_repeated_passages_go(tables):
    before = _rows(tables[2])
    after = defaultdict(list)
    for r in tables[3].collect():
        after[r.doc_id].append(r)
    for (i, text), (words, gone) in zip(before, windows_removed(before), strict=True):
        (r,) = after[i]
        assert r.text.encode().split() == [w for w, g in zip(words, gone, strict=True) if not g]
        assert r.n_chars == len(r.text) and (any(gone) or r.text == text)


def test_sources_meet_their_targets(tables):
    size, taken = defaultdict(int), defaultdict(int)
    for r in tables[3].collect():
        size[r.source] += len(r.text.encode().split())
    for r in tables[4].collect():
        taken[r.source] += len(r.text.encode().split())
    aim = _targets(size)
    assert all(abs(taken[s] - aim[s]) <= 4 * mixing.BLOCK_WORDS for s in size)


def test_ids_are_the_librarys(tables):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.default_path())
    want = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in _rows(tables[4]))
    got = tables[5].collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_run_equals_its_stages(spark, tables):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in tables[5].collect())


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("kind", ["edge", "empty", "nulls"])
def test_stages_on_odd_tables(spark, name, kind):
    rows = {"edge": edge_documents(), "empty": [], "nulls": [(None, None)] * 3}[kind]
    docs = frame(spark, rows).withColumn("n_chars", F.lit(None).cast("bigint"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    got = STAGES[name](spark, docs, SF)
    kept = got.collect()
    if name != "bpe":
        assert got.columns == corpus_pipeline.COLUMNS
    if name in ("substring_dedup", "bpe"):
        assert Counter(r.doc_id for r in kept) == Counter(i for i, _ in rows)
    if name == "simhash_near_dedup":
        assert Counter(r.doc_id for r in kept) == _one_of_each_group(rows)
    if name == "mixing":
        assert all(r.text for r in kept)


def test_every_contract_query_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
