"""The pipeline over planted documents: each stage's decisions, and the same rows as its stages by themselves."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm.common import new_path


def test_pipeline(spark, frame):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(2, 7))) for _ in range(600)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    items = [(k, prose(25)) for k in range(5)]
    rows = [(k, prose(60), "en", "abc"[k % 3]) for k in range(60)]
    rows += [(100, rows[0][1], "en", "a"), (101, rows[3][1] + " tail", "en", "b"), (102, f"{prose(30)} {items[1][1]}", "en", "c"), (103, " ".join(w + "***" for w in prose(40).split()), "en", "a"), (104, None, None, None), (105, "short", "en", "a")]
    folder = new_path(spark, "tables")
    frame(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({x["doc_id"] for x in docs.collect()})
    clean = set(range(60))
    assert kept[0] == clean | {100, 101, 102} and kept[1] == clean | {102} and kept[2] == clean
    assert kept[3] <= clean and kept[4] == kept[3]
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))
    ends = sorted((x["start"], x["n_tokens"]) for x in docs.collect())
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_pipeline_drops_copies_with_changed_words(spark, frame):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(3000)]
    rows = []
    for k, (n, changed) in enumerate([(50, [25]), (100, [30, 60]), (200, [40, 80, 120, 160])]):  # 0.80 to 0.82 on 5 words, 0.88 to 0.89 on 3
        text = r.sample(words, n)
        other = [f"new{j}" if j in changed else w for j, w in enumerate(text)]
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(other))]
    text = r.sample(words, 50)
    rows += [(90, " ".join(text)), (91, " ".join(f"new{j}" if j in (15, 35) else w for j, w in enumerate(text)))]  # 0.64
    stage = dict(corpus_pipeline.STAGES)["n-gram jaccard join"]
    assert {x["doc_id"] for x in stage(spark, frame(rows), "").collect()} == {0, 10, 20, 90, 91}


def through(spark, docs, folder):
    """The documents that each stage gives, written and read again."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_pipeline_of_rows_without_an_id_or_with_a_shared_one(spark, frame):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("abcdefghijklm", k=5)) for _ in range(n))
    item, copied, once = prose(25), prose(60), prose(60)
    rows = [(None, copied), (None, copied), (3, copied), (None, once), (7, prose(60)), (7, prose(60)), (None, f"{prose(30)} {item}"), (8, None), (None, ""), (None, None, None, None)] + [(100 + k, prose(60), None, None) for k in range(8)]
    folder = new_path(spark, "tables")
    frame(rows).withColumn("row", F.concat(F.lit("r"), F.col("doc_id"))).withColumn("text_hash", F.lit(1.5)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages = through(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["text"])
    kept = [sorted(s.collect(), key=key) for s in stages[:4]]
    assert [len(k) for k in kept[:3]] == [15, 13, 12] and all(s.columns == stages[0].columns for s in stages[:4])
    assert [x["doc_id"] for x in kept[1]] == [3, 7, 7, *range(100, 108), None, None] and once in {x["text"] for x in kept[2]}
    assert all(x["row"] == (None if x["doc_id"] is None else f"r{x['doc_id']}") and x["text_hash"] == 1.5 for k in kept for x in k)
    assert stages[4].count() == len(kept[3])


def test_pipeline_of_an_empty_table(spark, frame):
    folder = new_path(spark, "tables")
    frame([(1, "x")]).limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [s.count() for s in through(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)] == [0] * 5


def test_lazy_stages_keep_what_they_need(spark, frame):
    """Results of stages that are not written yet outlive other stages; run() leaves the token files only."""
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choices("abcdefghijklm", k=5)) for _ in range(n))
    tables = []
    for k in range(2):
        folder = new_path(spark, "tables")
        frame([(k * 100 + i, prose(50)) for i in range(20 + k)]).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        tables.append((folder, spark.read.parquet(f"{folder}/documents.parquet")))
    first, second = (corpus_pipeline.quality(spark, docs, folder) for folder, docs in tables)
    near = corpus_pipeline.near_duplicates(spark, tables[0][1], tables[0][0])
    assert second.count() == 21 and first.count() == 20 and near.count() == 20
    assert corpus_pipeline.run(spark, tables[0][0]).count() == 20 and first.count() == 20
