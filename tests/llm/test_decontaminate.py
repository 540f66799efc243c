import re

from factlake.llm import decontaminate as d

ITEMS = "item_id long, text string, doc_id string, h int"


def shingles(text, k=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs, items, share=0.8):
    out = set()
    for i, t in {(r.item_id, r.text) for r in items}:
        q = shingles(t)
        for j, x in {(r.doc_id, r.text) for r in docs}:
            n = len(q & shingles(x))
            if q and n >= share * len(q) - 1e-9:
                out.add((j, i, n, len(q)))
    return sorted(out, key=str)


def _run(docs, items, **kw):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in d.contaminated(docs, items, **kw).collect()), key=str)


def test_equals_brute_force(spark, noise):
    rng = noise.rng
    items = [(i, " ".join(noise(rng.randint(3, 60))), "x", 1) for i in range(25)] + [(99, None, "x", 1), (98, "", "x", 1), (3, "again other", "x", 1)]
    items.append(items[0])
    docs = []
    for j in range(120):
        words = noise(rng.randint(0, 300))
        if j % 3 == 0:
            leak = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 2)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in leak]
        docs.append((j, " ".join(words)))
    docs += [(None, items[1][1]), (200, items[2][1]), (200, items[2][1]), (201, None)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert _run(dd, ii) == brute(dd.collect(), ii.collect())
    assert _run(dd, ii, share=0.3) == brute(dd.collect(), ii.collect(), 0.3)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "word word word", "x", 1), (2, "a b c shared line", "x", 1), (3, None, "x", 1), (None, "end", "x", 1)], ITEMS)
    assert _run(odd_docs, items) == brute(odd_docs.collect(), items.collect())
    kept = d.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.where("text = 'a b c\nshared line'").count() == 0
    assert _run(no_docs, items) == _run(odd_docs, items.limit(0)) == []
    assert d.drop_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_native_plan(spark, odd_docs):
    items = spark.createDataFrame([(2, "a b c shared line", "x", 1)], ITEMS)
    assert "Python" not in d.contaminated(odd_docs, items)._jdf.queryExecution().executedPlan().toString()
