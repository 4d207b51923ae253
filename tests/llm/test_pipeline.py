"""The pipeline's stages on a small corpus, and each on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from tracemill.llm.common import save


def words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, make_docs):
    path = str(tmp_path_factory.mktemp("sf"))
    item = words("item", 30)
    near = words("near").split()
    near[30] = "other"
    docs = [
        (1, words("a"), "en", "s"), (2, words("a"), "en", "t"), (3, words("near"), "en", "s"), (4, " ".join(near), "en", "s"),
        (5, words("b") + " " + " ".join(item.split()[5:18]), "en", "s"), (6, words("c") + " token=abcdef123", "en", "s"),
        (7, "too short", "en", "s"), (8, None, None, None), (9, words("d", 3000), "en", "s"), (9, words("d", 3000), "en", "s"),
    ]
    make_docs(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [sorted(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = save(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[1:] == [[1, 2, 3, 4, 5, 6, 9, 9], [1, 3, 5, 6, 9], [1, 3, 6, 9], [1, 3, 6, 9]]
    (row,) = docs.filter("doc_id = 6").collect()
    assert row.text == words("c") + " <SECRET>" and row.n_chars == len(row.text)
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(packed.doc_id.unique()) == [1, 3, 6, 9]
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_on_odd_and_empty_tables(spark, folder, make_docs, odd_rows):
    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "words", "row"]
    for rows in (odd_rows, []):
        docs = make_docs(rows).select(*names)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(rows)
