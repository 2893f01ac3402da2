"""The stages of the pipeline, each on its own input."""

import random

import corpus_pipeline as pipeline


def test_stages(spark, words, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    for k in range(300):
        good = k % 4 > 0
        rows.append((k, prose(80) if good else " ".join(rng.choice(words).upper() + "!!" for _ in range(60)), "en", f"s{k % 3}", 0))
        labels.append((k, int(good), 0))
    good = [r for r in rows if r[0] % 4]
    rows += [(1000, good[0][1], "en", "s0", 0), (1001, good[1][1] + " tail", "en", "s0", 0)]
    passage = prose(60)
    rows += [(2000, prose(40) + "\n" + passage, "en", "s0", 0), (2001, passage + "\n" + prose(45), "en", "s0", 0), (None, prose(50), None, None, None)]
    rows += [(3000, None, "en", "s0", 0), (3001, good[2][1].upper().lower(), "en", "s1", 0)]
    own = "7.0 + coalesce(doc_id, 0) AS score", "cast(doc_id AS string) AS predicted", "1 AS keep_id", "'x' AS sources"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *own).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == columns
            assert all(r["score"] == 7.0 + (r["doc_id"] or 0) and r["predicted"] == (r["doc_id"] and str(r["doc_id"])) for r in docs.collect() if r["doc_id"] != 0)
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, exact, near, substring = seen
    assert not {k for k in quality if k is not None and k < 300 and k % 4 == 0} and {r[0] for r in good} <= set(quality)
    assert set(quality) - set(exact) == {1000, 3001} and set(exact) - set(near) == {1001}
    assert set(substring) == set(near) and passage.split()[5] and substring[2000].endswith(passage) and passage not in substring[2001]
    total = sum(r["length"] for r in docs.collect())
    assert total > 0 and {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(substring)
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_without_labels_nothing_is_rejected(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, pipeline.quality_stage(spark, docs, str(tmp_path)).collect())) == [(1, "a b c"), (2, None)]
