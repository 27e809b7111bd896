"""The pipeline against its parts by brute force, and on odd rows."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from test_near import brute_components
from test_packing import check_rows

from corpuscope.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    rows = docs.collect()
    kept = [r for r, known in zip(rows, model.predict([r.text for r in rows])[2], strict=True) if known]
    after = spark.createDataFrame(kept, docs.schema)
    judge = toxicity.train(after, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = [r for r in kept if judge.score(r.text) < toxicity.THRESHOLD]
    kept.sort(key=lambda r: r.doc_id)
    kept = [r for at, (r, group) in enumerate(zip(kept, brute_components([r.text for r in kept]), strict=True)) if group == at]
    result = corpus_pipeline.run(spark, FOLDER).collect()
    bins, total = check_rows(result, [(r.doc_id, r.text) for r in kept])
    assert 0 < len(kept) < len(rows) and bins <= total / 2048 * 1.05 + 1


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, "en", None, None, "x"), (2, "", None, "s", 0, None), (3, "12 34 !?", "en", "s", 8, "y"),
         (4, "the same words here again", "en", "s", 1, "z"), (5, "The same words\there again", "en", "s", 1, "z"),
         (5, "The same words\there again", "en", "s", 1, "z"), (None, "ein Text ohne Nummer", "de", "s", 1, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([(4, 1, 0), (4, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
        ids = sorted((r.doc_id or 0) for r in last.select("doc_id").distinct().collect())
        assert ids == ([0, 4] if frame is docs else [])


def test_vocabulary_is_outside_the_repository():
    assert not public_tokenizers.path("word_bpe_49k.json").startswith(str(corpus_pipeline.__file__).rsplit("/", 1)[0])
