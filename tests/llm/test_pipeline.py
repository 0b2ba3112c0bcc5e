"""The corpus pipeline stage by stage, on a small table and on odd rows."""

import corpus_pipeline as C
from tallyloom.llm import bpe, near_dedup, quality
from tallyloom.llm.stages import COLUMNS


def test_stages_in_order_with_the_columns_of_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.toPandas()
        if name != C.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    before = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.judge(before, quality.train(before)).where("kept").toPandas()
    assert sorted(kept["weak_label_quality"].doc_id) == sorted(judged.doc_id)
    filtered = spark.read.parquet(str(tmp_path / "weak_label_quality"))
    assert sorted(kept["order_minhash_dedup"].doc_id) == sorted({r["class_id"] for r in near_dedup.classes(filtered).collect()})
    assert list(kept["secret_scan"].doc_id.sort_values()) == list(kept["order_minhash_dedup"].doc_id.sort_values())
    assert not kept["secret_scan"].text.str.contains(r"token = \"[0-9a-f]{40}").any()
    assert set(kept["soft_mixing"].doc_id) == set(kept["secret_scan"].doc_id)
    assert len(kept["byte_bpe"]) == len(kept["soft_mixing"])
    want = bpe.digests(spark.read.parquet(str(tmp_path / "soft_mixing"))).toPandas()
    assert sorted(zip(want.doc_id, want.ids_sha256)) == sorted(zip(kept["byte_bpe"].doc_id, kept["byte_bpe"].ids_sha256))


def test_odd_rows_and_no_rows(spark, folder, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "A short clean text.", None, None, None), (2, "A short clean text.", None, None, None),
            (3, "A short clean text.", "en", "b", 19), (None, "No id but a text of its own.", "en", "b", 28)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS node", "2 AS kept")
    for n, docs in enumerate((odd, odd.where("false"))):
        for name, stage in C.STAGES:
            stage(spark, docs, folder).write.parquet(str(tmp_path / f"{n}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
        left = sorted(str(r["doc_id"]) for r in docs.collect())
        assert left in (["2", "None"], [])
