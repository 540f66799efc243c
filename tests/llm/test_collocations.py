import re
from collections import Counter, defaultdict

import pytest

from factlake.llm import collocations as C
from factlake.llm.count_automata import Automaton, build, compose, union


def test_automata_equal_dictionaries(noise):
    rng = noise.rng
    for _ in range(200):
        some = {tuple(rng.choice([b"a", b"b", b"ab", b"c\xff"]) for _ in range(rng.randint(0, 4))): rng.randint(1, 9) for _ in range(rng.randint(0, 60))}
        more = {k: rng.randint(1, 50) for k in list(some)[::2]} | {(b"zz",): 3}
        a, b = build(sorted(some.items())), build(sorted(more.items()))
        assert list(Automaton.unpack(*a.pack()).items()) == sorted(some.items())
        both = {k: some.get(k, 0) + more.get(k, 0) for k in some.keys() | more.keys()}
        assert list(union([a, b]).items()) == sorted(both.items())
        assert list(union([a, b], 7).items()) == sorted((k, n) for k, n in both.items() if n >= 7)
        assert list(compose(b, a)) == sorted((k, some[k]) for k in more if k in some)


def test_equal_futures_are_one_state():
    words = [b"%d" % i for i in range(50)]
    a = build(((w, x), 3) for w in sorted(words) for x in (b"p", b"q"))
    assert len(a.final) == 4  # empty, start, after the first word, end
    with pytest.raises(ValueError):
        build([((b"b",), 1), ((b"a",), 1)])


def brute(rows, least, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        for p, a in cand.items():
            inside = any(100 * b >= 100 * a and len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                out.append((lang, " ".join(p), len(p), a, l, r, n[lang], score))
    return sorted(out)


def _run(df, **kw):
    return sorted(tuple(r) for r in C.mined(df, **kw).collect())


def _texts(noise):
    rng = noise.rng
    words = noise(25, "abÀ", 3)
    rows = []
    for i in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", "\n", ".", " "]) for _ in range(rng.randint(0, 60)))
        if i % 4 == 0:
            text += " New York stock Exchange of " * 2
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [rows[0]] * 5 + [("en", None), (None, ""), ("fr", "a b a b"), ("en", "very " * 200), ("x\ny", "p q " * 9)]


@pytest.mark.parametrize("ranges,block_words", [(3, 1 << 20), (7, 40), (1, 7)])
def test_equals_brute_force(spark, noise, monkeypatch, ranges, block_words):
    """Also with blocks so small that texts are cut, and slices that end inside pieces."""
    monkeypatch.setattr(C, "SLICE", 50)
    rows = _texts(noise)
    df = spark.createDataFrame([(lang, t, i, 0) for i, (lang, t) in enumerate(rows)], "lang string, text string, n int, phrase int")
    for least, longest in ((6, 5),) if ranges > 1 else ((3, 3),):
        assert _run(df, least=least, longest=longest, ranges=ranges, block_words=block_words) == brute(rows, least, longest)


def test_large_products_are_exact(spark):
    """1000 * a * n beyond 64 bits."""
    df = spark.createDataFrame([(10**13, 10**17, 10**12, 10**13 - 1)], "a long, n long, l long, r long")
    assert df.select(C.score("a", "n", "l", "r")).first()[0] == 1000 * 10**13 * 10**17 // (10**12 * (10**13 - 1))


def test_odd_rows(odd_docs, no_docs, spark):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert _run(odd_docs, least=5) == brute(rows, 5, 5)
    assert _run(no_docs) == []
    assert _run(spark.createDataFrame([(None, None)], "lang string, text string")) == []


def test_shards_count_words_not_hashes(noise, monkeypatch):
    """Phrases of many blocks meet as arrays; those that share a hash stay apart, within a block and between blocks."""
    rng = noise.rng
    hashed = C.Block.hashed
    monkeypatch.setattr(C.Block, "hashed", lambda *a: ((at, h % C.np.uint64(5)) for at, h in hashed(*a)))
    known, held, want = lambda h: C.np.ones(len(h), bool), C._Shard(3), Counter()
    monkeypatch.setattr(C, "BLOCK_WORDS", 50)
    for lang in ["en", "de", "en", "en", "und"] * 4:
        words = sorted({b"a", b"b", b"ab", b"c\xff"})
        ids = [rng.randint(-1, 3) for _ in range(60)] if lang != "und" else [-1]
        block = C.zstd.ZstdCompressor().compress(C.np.array(ids, C.np.int32).tobytes())
        held.add(lang, C.Block(lang, 0, b"\n".join(words), block), known)
        for k in range(1, 4):
            want.update((lang.encode(), *(words[x] for x in ids[i: i + k])) for i in range(len(ids) - k + 1) if min(ids[i: i + k]) >= 0)
    cuts = sorted(want)[10::25]
    got = [x for r in held.built(cuts).to_pylist() for x in Automaton.unpack(r["labels"], r["shape"], r["counts"]).items()]
    assert got == sorted(want.items())
