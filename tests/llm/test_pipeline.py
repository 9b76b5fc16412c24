"""Every stage of the corpus pipeline does to its input what its operator decides."""

import random

import corpus_pipeline as cp

from strandlake.llm.toxicity import toxicity


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "tur", "en", "sa"]) for _ in range(rng.randint(1, 4)))
    docs, labels, leak = [], [], " ".join(word() for _ in range(30))
    for i in range(300):
        text = [word() for _ in range(60)]
        if i % 5 == 0:
            text[7:7] = ["idiotus", "scumble"]
        if i % 7 == 0:
            text = [w + "###" for w in text]
        if i in (101, 102):
            text[20:20] = leak.split()
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    docs += [(1000 + k, docs[3][1], "en", "s", 1) for k in range(3)] + [(1003, docs[4][1] + " more", "en", "s", 1), (1004, None, None, None, None), (1005, "", "en", "s", 0)]
    write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, leak)], "item_id long, text string")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        df = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
    everything = {d[0] for d in docs}
    rejected = {r["doc_id"] for r in toxicity(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    assert seen["toxicity"] == everything - rejected and len(rejected ^ {i for i in range(0, 300, 5)}) <= 2
    assert seen["quality_classifier"] == {i for i in seen["toxicity"] if i >= 1000 or i % 7}
    assert seen["minhash_near_dedup"] == seen["quality_classifier"] - {1000, 1001, 1002, 1003}
    assert seen["benchmark_decontamination"] == seen["minhash_near_dedup"] - {101, 102}
    assert seen["best_fit_packing"] == seen["benchmark_decontamination"]
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()} == seen["best_fit_packing"]
