import corpus_pipeline as C
from pyspark.sql import functions as F

from quillet.llm import decontaminate, disclosure, packing, simhash, toxicity
from quillet.llm.tokens import encoder


def test_stages_one_by_one_like_loops(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_dedup", "decontaminate", "pii", "pack"]
    stages = dict(C.STAGES)

    clean = stages["toxicity"](spark, docs, d).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    import pyarrow as pa

    ids = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity._scorer(model, False)(pa.array(list(ids.values()))).to_pylist()
    assert {r.doc_id for r in clean.collect()} == {i for i, s in zip(ids, scores) if s is None or s < model.threshold}

    single = stages["near_dedup"](spark, clean, d).cache()
    groups = {r.doc_id: r.keep_id for r in simhash.groups(clean).collect()}
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in clean.collect() if groups.get(r.doc_id, r.doc_id) == r.doc_id}
    texts = [r.text for r in single.collect()]
    assert len(set(texts)) == len(texts)

    fresh = stages["decontaminate"](spark, single, d).cache()
    bench = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in fresh.collect()}
    assert {r.doc_id for r in single.collect() if any(b in r.text for b in bench)} <= gone
    assert gone == {r.doc_id for r in decontaminate.matches(single, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}

    masked = stages["pii"](spark, fresh, d).cache()
    before = {r.doc_id: r.text for r in fresh.collect()}
    for r in masked.collect():
        assert disclosure.entity_spans(r.text) == [] and r.n_chars == len(r.text)
        assert disclosure.entity_spans(before[r.doc_id]) or r.text == before[r.doc_id]
    for x in (clean, single, fresh, masked):
        assert x.columns == docs.columns

    packed = stages["pack"](spark, masked, d).collect()
    counts = {}
    for r in packed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n_tokens
    assert counts == {r.doc_id: len(encoder().encode_ordinary(r.text)) for r in masked.collect()}
    docs.unpersist()


def test_run(spark, small):
    out = C.run(spark, small)
    assert out.columns == ["doc_id", "piece", "n_tokens", "bin_id", "position", "partition", "partition_bins", "partition_bound"]
    fill = out.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert fill and all(r.n <= packing.CAPACITY for r in fill)


def test_null_and_empty_rows_pass(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "lonely text without an id", "en", "s", 25), (77_777, None, "en", "s", 0), (88_888, "", None, None, None)], docs.schema)
    x = docs.union(odd).withColumn("keep", F.lit(1))
    for name, stage in C.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, x, small).write.parquet(path)
        x = spark.read.parquet(path)
        assert x.where("doc_id is null or doc_id in (77777, 88888)").count() == 3 and "keep" in x.columns
    assert C.STAGES[-1][1](spark, x, small).where("doc_id in (77777, 88888)").count() == 2
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_near_dedup_writes_no_square_of_a_dense_group(spark, small, monkeypatch):
    base = " ".join(f"word{i}" for i in range(200))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{base} new"), "id", F.lit(" more"), "id").alias("text"))
    rows = {}

    def written(df, tag, write=simhash.written):
        table = write(df, tag)
        rows[tag] = max(rows.get(tag, 0), table.count())
        return table

    monkeypatch.setattr(simhash, "written", written)
    assert [r.doc_id for r in dict(C.STAGES)["near_dedup"](spark, docs, small).collect()] == [0]
    assert 0 < rows["pairs"] < rows["nodes"] * simhash.layout(600, 20, 0.9)[1]
