"""The stages one by one and in a row, and the registered queries against brute force on small tables."""

import corpus_pipeline
from llm.helpers import WORDS, documents, empty_documents, odd_texts, prose

from tamarack.llm import minhash, quality, secrets


def write(spark, path, docs, labels=None):
    docs.write.parquet(f"{path}/documents.parquet")
    labels = labels or spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def corpus(spark):
    shared = "A passage that a good many of the documents hold word by word, and more."
    texts = odd_texts() + [prose(i, 120) + "\n" + (shared if i % 3 == 0 else "own ending") + f"\nclosing {i}" for i in range(30)]
    texts += [prose(3, 120) + f"\nclosing {i}" for i in range(4)] + [prose(50, 100) + " password = topsecret99 " + prose(51, 20)]
    return documents(spark, texts)


def test_stages_return_the_columns(spark, tmp_path):
    docs = corpus(spark)
    sf = write(spark, tmp_path / "t", docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            rows = out.collect()
            assert not rows or all(r.shard == "own" and r._h1 == "own" for r in rows)
            if name in ("line dedup", "secret scans"):
                assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows) and len(rows) == table.count()


def test_stages_take_effect(spark, tmp_path):
    docs = corpus(spark)
    sf = write(spark, tmp_path / "t", docs)
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    stats = quality.text_statistics(docs.select("doc_id", "text"))
    assert kept == {r.doc_id for r in stats.filter(~quality.base_failed()).collect()}
    near = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert near == {r.doc_id for r in minhash.near_duplicates(docs).filter("kept").collect()} and len(near) < docs.count()
    twice = docs.unionByName(docs)
    assert corpus_pipeline.near_duplicates(spark, twice, sf).count() == len(near)
    assert not any(secrets.find_secrets(r.text, secrets.Novelty()) for r in corpus_pipeline.redact_secrets(spark, docs, sf).collect())


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    docs = corpus(spark)
    sf = write(spark, tmp_path / "t", docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "secret scans", "packing"]
    step = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, sf).write.parquet(str(tmp_path / f"step{i}"))
        step = spark.read.parquet(str(tmp_path / f"step{i}"))
    rows = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert rows and sorted(map(key, rows)) == sorted(map(key, step.collect()))
    assert len({r.doc_id for r in rows}) == spark.read.parquet(str(tmp_path / "step3")).count()


def test_pipeline_of_nothing(spark, tmp_path):
    sf = write(spark, tmp_path / "t", empty_documents(spark))
    assert corpus_pipeline.run(spark, sf).collect() == []
    assert len(WORDS) == 20
