import collections
import zlib

import pytest

import corpus_pipeline
from relatum.llm import tokens
from tests.llm.test_duplicates import brute_components
from tests.llm.test_outputs import expected_tokens
from tests.llm.test_scans import brute_items


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        before = docs
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs))
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_rejects_marked_rows(spark, data, stages):
    kept = {r.doc_id for r in stages[0][1].collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    right = [(r.doc_id in kept) == bool(r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert sum(right) / len(right) > 0.9


def test_one_of_each_group_stays(stages):
    before, after = map(rows_of, stages[1])
    assert [i for i, _ in after] == sorted({c for _, _, c in brute_components(before)})


def test_no_benchmark_passage_stays(spark, data, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before, after = map(rows_of, stages[2])
    kept = {i for i, _ in after}
    for i, t in before:
        if len(t) < 3000:
            assert (i in kept) == (not brute_items(t, items))


def test_mix_repeats_whole_rows(stages):
    before, after = map(rows_of, stages[3])
    assert set(after) <= set(before) and max(collections.Counter(after).values()) <= 3


def test_tokens_of_the_mix(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[4][1].collect())
    assert got == [(s, i, n, c) for i, s, n, c in expected_tokens(rows_of(stages[4][0]), tok)]


def test_run_and_odd_rows(spark, data, odd, none):
    assert corpus_pipeline.run(spark, data).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0
        stage(spark, odd, data).collect()
    kept = corpus_pipeline.dedup_stage(spark, odd, data)
    assert kept.columns == odd.columns
    # 1 and 7 twice, 5 and 6, 8 and 9 are groups; rows without words stay.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 8, 10, 11, 12]
