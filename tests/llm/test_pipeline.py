"""The pipeline's stages, each on all that its predecessor kept."""

from collections import defaultdict

import numpy as np

import corpus_pipeline as cp
from fieldlark.llm import decontaminate, minhash_dedup


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, None, None), (-3, "1234", "en", "s", 4)], docs.schema)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs.unionAll(odd)
    held = {r.doc_id: r.text for r in before.collect()}
    for name, stage in cp.STAGES:
        after = stage(spark, before, sf_dir)
        if name == "packing":
            pieces = after.collect()
            assert {r.doc_id for r in pieces} == set(held)
            size = defaultdict(int)
            for r in pieces:
                size[r.sequence_id] += r.length
            assert max(size.values()) <= 1024 and sum(1024 - s for s in size.values()) < 0.02 * sum(size.values())
            assert {r.doc_id: r.doc_tokens for r in pieces} and all(len(r.ids) == 4 * r.length for r in pieces)
            break
        assert after.columns == docs.columns
        got = {r.doc_id: r.text for r in after.collect()}
        if name == "language_id":
            assert not {-1, -2, -3} & set(got) and len(got) > 0.98 * len(held) - 3
        if name == "minhash_dedup":
            cache = minhash_dedup._Words()
            sets = {i: minhash_dedup.shingle_set(t, 5, cache) for i, t in held.items()}
            kept = sorted(got)
            for i in sorted(set(held) - set(got)):
                assert any(5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) for j in held if j != i)
            for n, i in enumerate(kept):
                for j in kept[n + 1 :]:
                    a, b = len(sets[i]), len(sets[j])
                    if 5 * min(a, b) >= 4 * max(a, b):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        assert 5 * both < 4 * (a + b - both)
        if name == "decontamination":
            index = decontaminate.Index(bench, decontaminate.Leaks())
            ids = list(held)
            leaked = {ids[r] for r, *_ in index.find([held[i] for i in ids])}
            assert set(got) == set(held) - leaked and all(x not in t for t in got.values() for _, x in bench if len(x) > 60)
        if name == "pii":
            assert set(got) == set(held)
            same = sum(got[i] == held[i] for i in held)
            assert 0.5 * len(held) < same < len(held)
        before, held = spark.createDataFrame(after.rdd, after.schema), got


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
