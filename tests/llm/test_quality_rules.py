from collections import Counter

import numpy as np
import public_tokenizers

from factlake.llm import quality_rules as q

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(line.strip(q.GAPS))
        seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in q.SYMBOLS for c in text), dup, len(repeat))


def test_counts_equal_brute_force(noise):
    vocab = q.vocabulary(PIECES)
    for n in (0, 1, 3, 40, 400):
        text = "".join(w + noise.rng.choice([" ", "\n", "\t\n", "\x0b", " # "]) for w in noise(n, "abé", 2))
        assert q.measure(text, vocab)[:5] == brute(text)
    many = np.arange(3_000_000) % 2_500_000  # keys too wide for one product
    assert q.repeated_words(many) == 1_000_000


def test_bands_reject_what_stands_out(spark, noise):
    prose = [" ".join(noise(120, "abcdefghijklmnopqrst", 7)) for _ in range(300)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(prose)]
    rows += [(1000, " ".join(w.upper() + "!!" for w in noise(120)), "en"), (1001, "few words", "en"), (1002, "same three words " * 40, "en"),
             (1003, None, "en"), (1004, "", None)]
    got = {r.doc_id: r for r in q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert sum(got[i].kept for i in range(300)) >= 297
    assert not any(got[i].kept for i in (1000, 1001, 1002, 1003, 1004))
    assert [got[i].base_failed for i in (1000, 1001, 1002, 1003)] == [False, True, True, True]


def test_odd_rows(odd_docs, no_docs):
    got = q.verdicts(odd_docs, PIECES)
    assert got.count() == odd_docs.count() and q.verdicts(no_docs, PIECES).count() == 0
    rows = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert rows == Counter(brute(r.text) for r in odd_docs.collect())
