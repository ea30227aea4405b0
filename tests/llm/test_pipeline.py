"""The pipeline on planted rows."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decide(spark, docs, tmp_path):
    from tests_llm_rows import BENCH, OTHER, texts

    d = f"file://{tmp_path}"
    docs.union(docs.filter("doc_id = 6")).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 1 if i == 18 else 0) for i, _ in texts() if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (22, OTHER)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, d)
        assert frame.columns == docs.columns, name
    kept = sorted(r.doc_id for r in frame.collect() if r.doc_id is not None)
    # 1 repeats 0 but for case, 2 and 23 are near copies, 7 repeats 6, 11 holds two items, 18 is toxic.
    assert not {1, 2, 23, 7, 11, 18} & set(kept) and {0, 3, 4, 5, 6, 12, 14, 24} <= set(kept) and kept.count(6) == 1
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert sorted(i for i in out if i is not None) == kept
    assert out[4].n_tokens == 0 and out[4].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(corpus_pipeline.STAGES) == 5


def write(spark, d, documents, labels=(), benchmark=()):
    documents.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_stages_and_queries_on_odd_rows(spark, odd, tmp_path):
    """Clashing names, repeated rows, null ids and texts of more than a MiB, through every stage and query."""
    from tests_llm_rows import BENCH, OTHER

    from revlake.llm import queries

    d = f"file://{tmp_path}"
    write(spark, d, odd.repartition(3), [(18, 1, 1), (0, 1, 0), (6, 0, 0)], [(1, BENCH), (22, OTHER)])
    frame = spark.read.parquet(f"{d}/documents.parquet")
    total = frame.count()
    extra = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, d)
        assert frame.schema.names == odd.columns, name
        rows = frame.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in extra), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows), name
        sizes.append(len(rows))
        frame = spark.createDataFrame(rows, odd.schema)
    kept = [r.doc_id for r in frame.select("doc_id").collect()]
    assert 31 not in kept and kept.count(30) == 1 and kept.count(0) == 1 and kept.count(3) == 2  # rows without words stay
    assert corpus_pipeline.STAGES[-1][1](spark, frame, d).count() == sizes[-1]
    for name, query in queries.QUERIES.items():
        assert query(spark, d).count() == total, name


def test_empty_tables(spark, none, tmp_path):
    d = f"file://{tmp_path}"
    none.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
