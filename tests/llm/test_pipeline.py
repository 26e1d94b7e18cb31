"""The pipeline's stages, each against brute force on what the stage before kept."""

import re

import corpus_pipeline
from hedgerow.llm.common import staged


def test_stages(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    words = ["the", "of", "and", *[f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]]
    prose = lambda n: " ".join(rng.choice(words, n))
    shared = prose(40)
    texts = [prose(120) for _ in range(12)]
    texts += [texts[0].replace(" ", "  "), " ".join([*texts[1].split()[:-1], "other"]), "too short", None, prose(80) + " " + shared, prose(80) + " " + shared, "### $$$ " * 40]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == {*range(14), 16, 17}
    assert set(kept[1]) == {*range(12), 13, 16, 17}
    assert set(kept[2]) == {*range(12), 16, 17}
    assert set(kept[3]) == set(kept[2])
    assert shared in kept[3][16].text and shared not in kept[3][17].text
    assert all(r.n_chars == len(r.text) for r in kept[3].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    assert re.match(r"\w", corpus_pipeline.STAGES[0][0])
