from collections import Counter

from pyspark.sql import functions as F

from factlake.llm import common, line_dedup

GAP = " \t\n\x0b\x0c\r"


def brute(rows, min_docs):
    def keys(text):
        return [x.strip(GAP).translate({c: c + 32 for c in range(65, 91)}) for x in (text or "").split("\n")]

    seen = Counter(k for _, t in rows for k in set(keys(t)) if k)
    out = []
    for i, t in rows:
        lines, ks = (t or "").split("\n"), keys(t)
        kept = [x for x, k in zip(lines, ks) if not k or seen[k] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _run(df, **kw):
    return sorted(map(tuple, line_dedup.dropped_lines(df, **kw).collect()), key=str)


def test_equals_brute_force(spark, noise):
    rows = [(i, "\n".join(" ".join(noise(noise.rng.randint(0, 2), "aB", 1)) for _ in range(noise.rng.randint(1, 8)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (2, 10, 100):
        assert _run(df, min_docs=n) == sorted(brute(rows, n), key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _run(odd_docs, min_docs=10) == sorted(brute(rows, 10), key=str)
    assert _run(no_docs) == []
    kept = line_dedup.drop_shared_lines(odd_docs, min_docs=10)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert kept.where("doc_id = 10").first().text == "line of 0"


def test_heavy_join_equals_a_join_with_few_heavy_keys(spark):
    left = spark.range(2000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("v").alias("w"), F.max("v").alias("top")).where("k <> 6")
    for heavy in (1, 3, 50):
        for how in ("left", "inner", "left_semi"):
            want = left.join(right.drop("w"), "k", how).select("k", "v", *([] if how == "left_semi" else ["top"]))
            got = common.heavy_join(left, right, ["k"], "w", F.col("v"), how, heavy)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_native_plan(spark, odd_docs):
    plan = line_dedup.dropped_lines(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
