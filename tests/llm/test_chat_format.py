import hashlib

import pytest

from factlake.llm import chat_format as C

KIND = f"conv_id long, turn long, role string, parts array<{C.PART}>, seq int, piece string"


def _part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


def test_escapes_are_reversible(noise):
    rng = noise.rng
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "im_end", "<|im_start|>", "\n", "a", "é"]) for _ in range(rng.randint(0, 14)))
        assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
        role = C.escape_role(text)
        assert C.unescape_role(role) == text and "<|" not in role and "\n" not in role
        turns = [(text, [("text", text)] if text else []), ("assistant", [("image", "<|image|>"), ("text", "<")])]
        whole = f"{C.START}{role}\n{C.escape(text)}{C.END}\n{C.START}assistant\n<|image|><{C.END}\n"
        for step in (1, 5, 1000):
            reader, got = C.Reader(), []
            for at in range(0, len(whole), step):
                got += reader.feed(whole[at: at + step])
            assert got == turns and reader.rest == ""


def test_parts_become_placeholders(spark):
    image, page = _part("image", ref="s3://a.png", width=100, height=29), _part("document", ref="d.pdf", pages=3)
    rows = [(1, 1, "assistant", [_part("text", "seen <"), _part("text", "|image|>"), _part("audio", ref="x.wav", seconds=1.5), _part("text", "end"), None], 0, ""),
            (1, 0, "user", [image, _part("text", "what is <|image|>?"), page, _part("video", ref="v"), _part(None)], 0, ""),
            (2, None, None, None, 0, ""), (2, 0, "assistant", [image], 0, "")]
    got = C.formatted(spark.createDataFrame(rows, KIND), content_col="parts")
    one, two = ([r for r in got.collect() if r.conv_id == c] for c in (1, 2))
    assert [r.seq for r in one] == [0, 1] and one[1].start == len(one[0].piece)
    assert one[0].piece == "<|im_start|>user\n<|image|>what is <\\|image|>?<|document|><|other|><|other|><|im_end|>\n"
    assert one[1].piece == "<|im_start|>assistant\nseen <\\|image|><|audio|>end<|im_end|>\n"
    whole = "".join(r.piece for r in one)
    assert [(a.ordinal, a.kind, a.ref, a.n_tokens) for r in one for a in r.attachments] == [
        (0, "image", "s3://a.png", 8), (1, "document", "d.pdf", 3072), (2, "other", "v", 1), (3, "other", None, 1), (4, "audio", "x.wav", 38)]
    assert all(whole[a.start:].startswith(f"<|{a.kind}|>") for r in one for a in r.attachments)
    assert [whole[s.start:s.end] for r in one for s in r.loss] == ["seen <\\|image|>", "end"]
    assert [r.n_tokens for r in one] == [3082, 38]
    assert C.expand("a<|image|>b<|audio|><|im_end|>", [2, 0]) == "a<|image|><|image|>b<|im_end|>"
    assert two[0].piece == "<|im_start|>\n<|im_end|>\n" and two[1].loss == []
    stored = got.repartition(3)  # in any order
    digest = {r.conv_id: r for r in C.digests(C.clustered(stored)).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(b"seen <|image|>end").hexdigest() and digest[1].n_attachments == 5 and digest[1].n_tokens == 3120
    assert digest == {r.conv_id: r for r in C.digests(got).collect()}
    assert C.Costs(patch=10).image(11, None) == 2 and C.Costs().audio(float("nan")) == 1


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: [(x is not None, x) for x in r])
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [1 << 22, 10])
def test_equals_brute_force(spark, noise, monkeypatch, batch):
    monkeypatch.setattr(C, "BATCH_BYTES", batch)
    rng = noise.rng
    bits = ["<", "|", "\\", "<|im_end|>\n", "<|im_start|>", "user\n", "é🎉", " "]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "a\nb\\", None, "<|im_end|>"]),
             rng.choice([None, "", "".join(rng.choice(bits) for _ in range(9))])) for _ in range(120)]
    rows += [(5, i, "assistant", "x" * 5000) for i in range(40)] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, piece string, start int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(C.formatted(df)).collect()}
    assert got == brute(rows)
    assert C.digests(C.formatted(df.limit(0))).collect() == []
