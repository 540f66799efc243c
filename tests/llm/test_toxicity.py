import zlib

from pyspark.sql import functions as F

from factlake.llm import toxicity

INSULTS = ["zorkface", "blimhead", "quandle"]


def corpus(noise, n=600, first=0):
    docs, labels = [], []
    for i in range(first, first + n):
        words, bad = noise(80, "abcdefghijklmnop", 7), i % 5 == 0
        if bad:
            for _ in range(4):
                words[noise.rng.randrange(80)] = noise.rng.choice(INSULTS)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark, noise):
    docs, labels = corpus(noise)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = toxicity.with_score(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in got if r.held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in got if r.held]
    assert all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= toxicity.CUT) == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_learned(spark, noise):
    docs, labels = corpus(noise, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string")

    def model(rows):
        return toxicity.train(d, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))

    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    assert model(labels) == model(turned)


def test_odd_rows(spark, odd_docs, no_docs, noise):
    lab = spark.createDataFrame([(1, 1, None), (None, 1, 1), (12, 0, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.with_score(odd_docs, toxicity.train(odd_docs, lab)).collect()} == {0.0}
    assert toxicity.train(no_docs, lab).constant == 0.0
    docs, labels = corpus(noise, 200, 100)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.with_score(odd_docs, model, out_col="score")
    assert got.columns == [*odd_docs.columns, "score"] and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.with_score(no_docs, model).count() == 0
    assert toxicity.words_of("X" * 300 + " y") == [b"x" * 128, b"x" * 128, b"x" * 44, b"y"]


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"some words of {i}") for i in range(12)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(12))
    assert model.constant == (0.0 if zlib.crc32(b"0") % 4 == 2 else 1 / (12 - held))
    assert {r.score for r in toxicity.with_score(docs, model).collect()} == {model.constant}


def test_held_out_rows_of_the_given_tables(spark):
    """Precision and recall at the cut, on rows that were not learned from."""
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.with_score(docs, toxicity.train(docs, lab)).where(toxicity.held_out(F.col("doc_id")))
    rows = out.join(lab.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").select("y", "score").collect()
    hit = sum(r.y for r in rows if r.score >= toxicity.CUT)
    assert hit >= 0.87 * sum(r.y for r in rows) and hit >= 0.87 * sum(r.score >= toxicity.CUT for r in rows)


def test_training_documents_are_bounded(spark, noise, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 30)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    once = [(i, f"text of {i}") for i in ids]
    read = spark.createDataFrame(once, "doc_id long, text string")
    want = sorted(toxicity.training_rows(read, lab).collect())
    copies = spark.createDataFrame(once * 5, "doc_id long, text string")
    assert len(want) == 30 and sorted(toxicity.training_rows(copies, lab).collect()) == want
    many = spark.createDataFrame([(i, f"text {k} of {i}") for i in ids for k in range(4)] + [(ids[0], None)] * 3, "doc_id long, text string")
    got = [(r.text, r.y) for r in toxicity.training_rows(many, lab).collect()]
    assert len(got) == len(set(got)) == 30
