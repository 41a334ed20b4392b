from collections import Counter

import corpus_pipeline
from graphloom.llm import simhash
from test_search_pack_hash import brute_components, brute_fp, check_packing
from test_shingle_dedup import brute_keep


def test_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(stage(spark, inputs[-1], sf).cache())
        assert inputs[-1].columns == columns
    kept, lines, unique, mixed = inputs[1:]
    assert 0 < kept.count() < docs.count() and kept.exceptAll(docs).isEmpty()
    assert lines.count() == kept.count()
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(r.doc_id for r in unique.collect()) == sorted(brute_keep(rows)) and unique.exceptAll(lines).isEmpty()  # five words, similarity of 0.8
    assert set(r.doc_id for r in mixed.collect()) <= set(r.doc_id for r in unique.collect()) and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf).collect()
    check_packing(mixed, packed, 2048)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, packed))


def test_stages_take_odd_rows(spark, odd, empty, sf):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf).cache()
            assert docs.columns == table.columns
        pieces = corpus_pipeline.pack_sequences(spark, docs, sf)
        assert (pieces.count() == 0) == (docs.count() == 0)
    assert simhash.one_of_each(odd).count() == len({c for *_, c in brute_components([(r.doc_id if r.doc_id is not None else 10**6, brute_fp(r.text)) for r in odd.collect()])})
