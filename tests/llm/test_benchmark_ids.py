from texts import prose

from tessera.llm.decontamination import contaminated, without_contaminated


def test_repeated_and_null_item_ids(spark, rng):
    texts = [prose(rng, n) for n in (54, 15, 54, 15, 54, 15, 30, 20)]
    items = [(1 + i // 2, t) for i, t in enumerate(texts[:6])] + [(None, t) for t in texts[6:]] + [(1, texts[0])] * 2
    documents = spark.createDataFrame([(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for i, t in enumerate(texts)] + [(99, prose(rng, 60))], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start) for r in contaminated(documents, benchmark).collect()}
    assert got == {(i, 1 + i // 2 if i < 6 else None, 30) for i in range(8)}
    assert [r.doc_id for r in without_contaminated(documents, benchmark).collect()] == [99]
