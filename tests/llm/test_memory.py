"""What Python workers keep, and the number of files that tasks write, stays small."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm import common, packing, simhash_dedup, tokens, toxicity


def test_workers_forget_what_other_stages_kept():
    tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), entries=1000)
    simhash_dedup.shingle_sets([b"one two three four five six"])
    with common.spare("tokens"):
        assert tokens._encoders and not simhash_dedup._word_hashes
    with common.spare():
        assert not tokens._encoders


def test_stages_leave_no_encoder_with_the_workers(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(40)], "doc_id long, text string").repartition(4)

    def held(batches):
        from tessera.llm import tokens

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(tokens._encoders)] * batch.num_rows, pa.int64())})

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(docs, path, memo_entries=1000).agg(F.sum("length")).first()[0] > 0
    chain = toxicity.Chain(["toxic"], {}, [np.zeros(1)])
    docs.select(toxicity.is_toxic(chain)("text")).collect()
    assert docs.mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_short_rows_of_many_partitions_are_few_files(spark):
    from tessera.llm.components import connected_components

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        out = connected_components(edges)
        assert len(out.inputFiles()) <= scratch.FILES_A_CORE * spark.sparkContext.defaultParallelism
        assert [r.root for r in out.select("root").distinct().collect()] == [0] and out.count() == 2001
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
