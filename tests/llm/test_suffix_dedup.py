from collections import Counter

import numpy as np
import pytest

from factlake.llm import induced_sort, suffix_dedup

SMALL = {"length": 20, "gram": 6}


def repeated(raw, n):
    at = {}
    for i in range(len(raw) - n + 1):
        at.setdefault(raw[i: i + n], []).append(i)
    return sorted(i for v in at.values() if len(v) > 1 for i in v)


@pytest.mark.parametrize("block,ranges,budget", [(1 << 14, 32, 1 << 27), (3, 4, 64), (7, 2, 10)])
def test_sorter_equals_brute_force(monkeypatch, noise, block, ranges, budget):
    """Also with blocks, ranges and memory so small that every tape is spilled."""
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    monkeypatch.setattr(induced_sort, "RANGES", ranges)
    rng = noise.rng
    for k in range(150):
        letters = rng.choice([1, 2, 3, 26, 200])
        t = [rng.randint(2, 1 + letters) for _ in range(rng.randint(1, 90))]
        t = np.array([*(t[:15] + t[3:15] + t if k % 3 == 0 else t), 0], np.uint8)
        raw, disk = t.tobytes(), induced_sort.Disk(budget)
        assert induced_sort.suffix_order(t, int(t.max()) + 1, disk).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        assert disk.spilled or budget > 1000 or len(t) < 10
        for cap in (3, 9, 17):
            assert np.flatnonzero(induced_sort.repeats(t, cap, budget)).tolist() == repeated(raw, cap)


def brute(rows, n):
    seen = Counter(raw[i: i + n] for _, raw in rows for i in range(len(raw) - n + 1))
    out = []
    for doc, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if seen[raw[i: i + n]] > 1:
                gone[i: i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, bytes(c for c, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def _run(df, **kw):
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.drop_repeats(df, **kw).collect()), key=str)


def _raw(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.collect()]


def test_equals_brute_force(spark, noise, monkeypatch):
    rng = noise.rng
    shared = ["".join(noise(30, "abcdefg", 3)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(noise(20))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            text += s[a: rng.randint(a, len(s))] + "".join(noise(rng.randint(0, 4)))
        if i % 10 == 0:
            text += "ab" * rng.randint(5, 40) + "é" * rng.randint(0, 40)  # repeats of its own
        rows.append((i, text))
    rows += [rows[3], rows[3], (100, rows[4][1]), (None, rows[5][1]), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(_raw(df), 20)
    assert _run(df, **SMALL) == want
    assert _run(df, **SMALL, shards=2, budget=500) == want
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)  # keys of three segments and more are compared by window
    assert _run(df, **SMALL) == want
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    assert [list(x) for x in zip(*[c.tolist() for b in suffix_dedup.segments_of(b"abc" * 60, 20, 6) for c in b[:2]][0::2])]


def test_blocks_of_a_long_text_hold_every_window(monkeypatch, noise):
    raw = "".join(noise(400)).encode()
    whole = [(a, n, k) for b in suffix_dedup.segments_of(raw, 20, 6) for a, n, k in zip(*(c.tolist() for c in b[:3]))]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    parts = [(a, n, k) for b in suffix_dedup.segments_of(raw, 20, 6) for a, n, k in zip(*(c.tolist() for c in b[:3]))]

    def keys(segments):
        return [k for a, n, k in segments for _ in range(n)]

    assert keys(whole) == keys(parts) and len(keys(whole)) == len(raw) - 19


def test_odd_rows(odd_docs, no_docs):
    assert _run(odd_docs) == brute(_raw(odd_docs), 200)
    assert _run(no_docs) == []


def test_minima_are_held_within_the_budget():
    """Positions beyond the budget are in a mapped file, blocks are not kept beside it."""
    import tracemalloc

    text = np.random.default_rng(1).integers(1, 200, 4_000_000).astype(np.uint8)
    text[-1] = 0
    disk = induced_sort.Disk(1 << 20)
    tracemalloc.start()
    found = induced_sort.minima(text, disk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(found, np.memmap) and len(found) > 1_000_000 and peak < 40 << 20
    assert (text[found - 1] > text[found]).all() and (np.diff(found) > 1).all()


def test_order_of_names_sorts_on_only_what_is_equal(monkeypatch):
    rng, sizes, argsort = np.random.default_rng(5), [], np.argsort
    monkeypatch.setattr(induced_sort.np, "argsort", lambda a, **k: sizes.append(len(a)) or argsort(a, **k))
    for names in ([1, 0], [2, 2, 2, 2, 2, 2, 2, 0], [1, 2, 1, 2, 1, 2, 1, 2, 2, 0], [*rng.integers(1, 4, 300).tolist(), 0], [*range(1000, 0, -1), 7, 7, 0]):
        sizes.clear()
        got = induced_sort.doubled_order(np.array(names, np.int32))
        assert got.tolist() == sorted(range(len(names)), key=lambda i: names[i:])
    assert len(sizes) > 1 and sum(sizes[1:]) <= 10
