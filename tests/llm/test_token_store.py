import io
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factlake.llm import token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_codes_give_every_id_back():
    for ids in ([0], [1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 0] * 700, list(range(5000)), [7] * 513):
        seg = token_store.Segment(token_store.pack(np.array(ids, "<u4")))
        assert len(seg) == len(ids) and seg.ids().tolist() == ids and [seg[i] for i in range(len(ids))] == ids


def test_file_of_many_segments(monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 100)
    rng, sink = np.random.default_rng(1), io.BytesIO()
    docs = [(i if i != 3 else None, rng.integers(0, 70_000, rng.integers(0, 250)).astype("<u4")) for i in range(20)]
    w = token_store.StoreWriter(sink)
    for doc_id, ids in docs:
        w.add(doc_id, iter([ids]))
    w.close()
    sink.size = lambda: len(sink.getvalue())
    r, at, flat = token_store.StoreReader(sink), 0, np.concatenate([x for _, x in docs])
    for (doc_id, ids), (got_id, first, n) in zip(docs, r.documents(), strict=True):
        got = list(r.ids(first, n))
        assert (got_id, first, n) == (doc_id, at, len(ids)) and (not n or (np.concatenate(got) == ids).all())
        at += n
    assert [r[i] for i in range(0, len(flat), 37)] == flat[::37].tolist()


def test_store_equals_the_library(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(PATH)
    rows = odd_docs.collect()
    got = token_store.token_store(odd_docs, PATH).orderBy("start").collect()
    ids = [*sorted((r.doc_id for r in rows if r.doc_id is not None))]
    assert [r.doc_id for r in got] == [None, None, *ids]
    start = 0
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got:
        want = by_id[r.doc_id][0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_store.token_store(no_docs, PATH).count() == 0


def test_a_full_memo_learns_the_new_words_only(monkeypatch):
    enc = token_store.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = [np.concatenate(list(enc.blocks(t))).tolist() for t in ("alpha beta gamma", "alpha delta beta delta gamma")]
    enc.memo.clear()
    monkeypatch.setattr(token_store, "WORDS", 3)
    assert np.concatenate(list(enc.blocks("alpha beta gamma"))).tolist() == whole[0]
    assert np.concatenate(list(enc.blocks("alpha delta beta delta gamma"))).tolist() == whole[1]
    assert set(enc.memo) == {b"delta"}


def test_neighbouring_texts_are_learned_at_once(monkeypatch):
    enc, calls = token_store.LibraryEncoder(PATH), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: calls.append(len(words)) or learn(words))
    texts = ["alpha beta.", None, "beta gamma", "", "Ünï <|endoftext|> 日本 don't"] * 3
    got = [np.concatenate([*blocks, []]).tolist() for blocks in enc.each(texts)]
    t = Tokenizer.from_file(PATH)
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts] and calls == [8]
    # a text beyond the limit comes in blocks of its own, in its place
    monkeypatch.setattr(token_store, "LOOKED_UP", 3)
    texts = ["a b", "one two three four five", "c", "d e f g", ""]
    assert [np.concatenate([*b, []]).tolist() for b in enc.each(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_latin_words_need_only_the_librarys_model():
    text = "Alpha beta, don't stop!! x\x01y \x7f ~|~ 3.14 Stra\u00dfe, \u00c9T\u00c9. it's"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    enc = token_store.LibraryEncoder(PATH)
    enc.tokenizer = None
    assert np.concatenate(list(enc.blocks(text))).tolist() == want
