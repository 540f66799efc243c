import xxhash
from pyspark.sql import functions as F

from factlake.llm import simhash


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i: i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius):
    ids = list(rows)
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (ids[a][1] ^ ids[b][1]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    best = {}
    for i, (doc, _) in enumerate(ids):
        r = find(i)
        if doc is not None:
            best[r] = min(best.get(r, doc), doc)
    return sorted(((doc, fp, best.get(find(i))) for i, (doc, fp) in enumerate(ids)), key=str)


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint_equals_brute_force(noise):
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = " \t\n".join(noise(n, "aBcÄ"))
        assert simhash.fingerprint(text) == slow_print(text)
    assert simhash.fingerprint(None) == 0


def test_components_equal_brute_force(spark, noise):
    rng, rows = noise.rng, []
    for _ in range(25):  # chains of fingerprints, one to three bits apart, and copies
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 7)):
            for _ in range(rng.randint(0, 3)):
                fp ^= 1 << rng.randrange(64)
            rows += [(rng.randrange(10_000), fp)] * rng.randint(1, 2)
    rows += [(None, rows[0][1]), (None, 12345)]
    for radius in (0, 1, 2):
        prints = spark.createDataFrame([(i, _signed(f)) for i, f in rows], "_id long, fp long")
        named = simhash.component_ids(prints, "_id", radius)
        got = prints.join(named, "fp").select("_id", "fp", "component_id").collect()
        assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=str) == slow_components(rows, radius)


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    rows = [(r.doc_id, slow_print(r.text)) for r in odd_docs.collect()]
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got.collect()), key=str) == slow_components(rows, 2)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert [r[0] for r in kept.where("text is null or trim(text) = ''").select("doc_id").collect()] == [1]


def test_one_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same few words")).otherwise(
        F.concat(F.lit("other words here "), F.sha1(F.col("id").cast("string")))).alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.where("doc_id % 3 > 0").select("component_id").distinct().collect()[0][0] == 1


def test_one_doc_id_in_two_components(spark):
    first, second = "the quick brown fox jumps over the lazy dog", "entirely other words that stand in another component"
    rows = [(3, first, "x", 1), (7, first, "y", 2), (7, second, "x", 3), (9, second, "y", 4), (None, second, "x", 5), (7, second, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, gone_id int")
    kept = simhash.keep_one(docs)
    assert sorted(r.gone_id for r in kept.collect()) == [1, 3, 5, 6] and kept.columns == docs.columns
