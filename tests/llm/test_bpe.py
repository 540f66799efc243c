import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "a", "don't stop 'stupid it's 'S 'RE", "<|endoftext|>x<|startoftext|> <|endoftext", "İstanbul ΣΑΣ ß ﬁ é ̈́",
         "12345 abc123def !!!??? ...", "\x1c\x1d a\xa0b c​d\x85e", "日本語テキスト 🎉👨‍👩‍👧", "a" * 5000, "the" * 3000 + "ing" * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_equal_the_library(library, noise):
    enc, dec = bpe.encoder(PATH), bpe.decoder(PATH)
    texts = TEXTS + ["".join(noise(4, "abcdethinrous'", 20)) for _ in range(3000)] + ["".join(noise(6, "aabé", 9)) for _ in range(1000)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == ids
        assert dec.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_stream_is_bounded_and_equal(library):
    merges = bpe.encoder(PATH).merges
    word = b"thingsandthe" * 4000
    runs = list(merges.stream(word))
    assert len(runs) > 5 and [t for r in runs for t in r] == library.encode(word.decode(), add_special_tokens=False).ids
    short = b"internationalisation"
    assert [t for r in merges.stream(short) for t in r] == merges.tokens(short)


def test_decoder_ends_blocks_inside_a_character(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 1)
    plain = bpe.Decoder(PATH, plain=True)
    assert plain.decode(bpe.encoder(PATH).encode("née 日本 zz")) == "née 日本 zz "


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs, library):
    import hashlib

    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd_docs, PATH).collect()}
    want = set()
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want and bpe.round_trip(no_docs, PATH).count() == 0
    both = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH)
    assert both.columns == [*odd_docs.columns, "ids", "decoded"] and both.count() == odd_docs.count()


def test_every_pre_token_goes_through_the_transducer(monkeypatch):
    enc, seen = bpe.Encoder(PATH), []
    stream = bpe.Merges.stream
    monkeypatch.setattr(bpe.Merges, "stream", lambda self, word: seen.append(word) or stream(self, word))
    text = "Plain words, don't repeat words. " + "long" * 2000
    want = [x for w in text.split() for x in enc.parting.parted(w)]
    enc.encode(text)
    assert set(seen) == set(want) and len(seen) == len(set(want))


def test_memory_does_not_grow_with_the_text(library):
    import hashlib
    import tracemalloc

    enc, dec = bpe.Encoder(PATH), bpe.decoder(PATH)
    for text in ("some plain words in it " * 100_000, "thingsandthe" * 30_000):
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        tracemalloc.start()
        got = bpe.digests(text, enc, dec)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        shown = library.decode(want, skip_special_tokens=False)
        assert got == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
        assert max(map(len, enc.blocks(text))) <= 8 * bpe.BLOCK and peak < 8 << 20


def test_plain_words_are_parted_as_by_the_pattern(noise):
    parting = bpe.Parting(PATH)
    words = noise(3000, "aZé.,'ßIİ1ȺŉÿÅ", 5) + ["don't", "<|", "a.b", "...", "A.", ".", "日.", "ǅ!", "a;", "é", "Ⱥ"]
    plain = {w: parting.plain(w.encode()) for w in words}
    assert all(got is None or got == parting.parted(w) for w, got in plain.items())
    assert sum(got is not None for got in plain.values()) > 100 and plain["A."] == [b"a", b"."] and plain["don't"] is None


def test_a_full_memo_keeps_what_is_asked_for_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 2)
    asked = []
    memo = bpe.Memo(lambda w: asked.append(w) or w * 2)
    for w in (b"the", b"x1", b"x2", b"the", b"x3", b"the", b"x4"):
        assert memo[w] == w * 2
        assert len(memo) <= 2 and len(memo.before) <= 2
    assert asked.count(b"the") == 1


def test_pairs_are_found_again_after_a_full_memo(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO", 5)
    enc = bpe.Encoder(PATH)
    for t in ("internationalisation of thingsandthe others", "thingsandthe internationalisation"):
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert enc.merges._n_known <= 6 and sum(map(len, enc.merges._known.values())) == enc.merges._n_known


def test_workers_keep_no_words_after_a_task(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more words, {i}") for i in range(64)], "doc_id long, text string").repartition(16)
    path = PATH

    @F.pandas_udf("long")
    def held(ids: pd.Series) -> pd.Series:
        enc = bpe.encoder(path)
        return pd.Series([sum(map(len, (enc.memo, enc.memo.before, enc.pieces, enc.pieces.before)))] * len(ids))

    for made in (bpe.round_trip(docs, path), bpe.encode_texts(docs, path)):
        assert made.count() == 64 and len(made.collect()) == 64
        assert spark.range(0, 64, 1, 64).select(held("id").alias("n")).agg(F.max("n")).first()[0] == 0
