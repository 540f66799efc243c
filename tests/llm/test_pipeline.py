import corpus_pipeline
from factlake.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns, name
            docs = out
        else:
            assert {"doc_id", "n_tokens"} <= set(out.columns)
        left = {r.doc_id for r in out.collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        ids = left
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == ids


def test_each_stage_takes_an_empty_table(spark, no_docs):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


INSULTS = ["zorkface", "blimhead", "quandle"]


def planted(noise):
    """(doc_id, text, kind) with labels and a benchmark: ordinary documents of
    random words, and beside them toxic ones, near copies, lines that many
    documents have, and documents with a benchmark item."""
    rows, rng = [], noise.rng

    def words(n):
        return noise(n, "abcdefghijklmnop", 7)

    for i in range(400):
        own = words(80)
        if i % 5 == 0:
            for at in rng.sample(range(80), 12):
                own[at] = rng.choice(INSULTS)
        rows.append((i, " ".join(own), "toxic" if i % 5 == 0 else "plain"))
    items = [(i, " ".join(words(20))) for i in range(3)]
    for i in range(12):  # a line that twelve have; one that nine have stays
        nine = "\nthis line stands in nine" if i < 9 else ""
        rows.append((500 + i, f"{' '.join(words(40))}\nThis line stands in twelve {nine}\n{' '.join(words(40))}", "shared"))
    for i in range(6):
        leak = items[i % 3][1].upper().replace(" ", ", ") if i < 5 else " ".join(items[0][1].split()[:10])  # the last has too little of it
        rows.append((600 + i, f"{' '.join(words(60))} {leak} {' '.join(words(60))}", "leak"))
    for i in range(4):
        text = " ".join(words(90))
        rows += [(700 + 10 * i + k, text.upper() if k == 2 else text, "copy") for k in range(3)]
    rows += [(800, None, "empty"), (801, "", "empty"), (None, rows[1][1], "copy")]
    return rows, items


def test_stages_equal_plain_python(spark, noise, tmp_path):
    import public_tokenizers
    from test_decontaminate import brute
    from test_simhash import slow_components, slow_print
    from tokenizers import Tokenizer

    rows, items = planted(noise)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(kind == "toxic")) for i, _, kind in rows if kind in ("toxic", "plain")],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        return sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, str(tmp_path)).collect()), key=str)

    def given(pairs):
        return spark.createDataFrame(pairs, "doc_id long, text string")

    want = [(i, t) for i, t, kind in rows if kind != "toxic"]
    assert run("toxicity") == sorted(want, key=str)
    docs = given(want)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").lower()

    def shared(pairs):
        having = {}
        for at, (_, t) in enumerate(pairs):
            for line in (t or "").split("\n"):
                if key(line):
                    having.setdefault(key(line), set()).add(at)
        return {line for line, who in having.items() if len(who) >= 10}

    gone = shared(want)
    assert gone == {"this line stands in twelve"}
    want = [(i, t and "\n".join(x for x in t.split("\n") if key(x) not in gone)) for i, t in want]
    got = run("line_dedup")
    assert sorted(((i, t or "") for i, t in got), key=str) == sorted(((i, t or "") for i, t in want), key=str)
    want, docs = got, given(got)

    prints = [(i, slow_print(t)) for i, t in want]
    names = {(i, fp): c for i, fp, c in slow_components(prints, 2)}
    want = [(i, t) for (i, t), p in zip(want, prints, strict=True) if i is None or names[p] == i]
    assert run("simhash") == want and sum(700 <= (i or 0) < 800 for i, _ in want) == 4
    docs = given(want)

    found = {i for i, *_ in brute(docs.collect(), spark.createDataFrame(items, "item_id long, text string").collect())}
    assert found == {600, 601, 602, 603, 604}
    want = [(i, t) for i, t in want if i not in found]
    assert run("decontaminate") == want
    docs = given(want)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(((r.doc_id, r.n_tokens) for r in stages["bpe"](spark, docs, str(tmp_path)).collect()), key=str) == sorted(
        ((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in want), key=str)
