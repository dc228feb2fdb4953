"""The pipeline's stages one by one, each on its own input, against plain Python."""

import zlib

import brute
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text or "") for r in docs.collect()]
        made = stage(spark, docs, tables)
        path = f"{tables}/stage-{name}"
        made.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
            kept = [(r.doc_id, r.text or "") for r in after.collect()]
            assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in after.collect())
        if name == "quality_rules":
            assert set(kept) <= set(before) and all(not brute.op7(x)[-1] for _, x in kept)
            good = [(d, x) for d, x in before if not brute.op7(x)[-1] and brute.op7(x)[2] == 0 and not x.isupper() and len(x) < 2000 and "@" not in x and "same line" not in x]
            assert set(good) <= set(kept)
        elif name == "jaccard_join":
            groups = brute.op3(dict(before))
            assert sorted(d for d, _ in kept) == sorted({g for _, g in groups.values()})
        elif name == "suffix_dedup":
            whole = brute.op6(dict(enumerate(x for _, x in before)))
            assert sorted(d for d, _ in kept) == sorted(d for d, _ in before)
            for i, (d, x) in enumerate(before):
                assert (dict(kept)[d] == x) == (whole[i][1] == 0)
        elif name == "pii":
            for d, x in before:
                assert (dict(kept)[d] == x) == (sum(brute.op9(x)[:4]) == 0 or x == "")
            assert not any("@mail" in x for _, x in kept)
        else:
            got = {}
            for r in after.collect():
                got.setdefault(r.doc_id, []).append(r)
            assert set(got) == {d for d, _ in before}
            for d, x in before:
                ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
                assert sum(r.length for r in got[d]) == len(ids)
                assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got[d])
        docs = after


def test_run(spark, tables, empty_tables):
    assert corpus_pipeline.run(spark, tables).count() > 0
    assert corpus_pipeline.run(spark, empty_tables).collect() == []
