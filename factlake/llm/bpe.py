"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A BPE encoding is the only sequence of tokens in which every neighbouring pair
is stable: no merge rule would have crossed their border before the pair's own
parts were merged away. So the encoder reads a pre-token symbol by symbol and
keeps, for each position, the one last token of the prefix that ends there.
Only positions within the longest token of the reading head can still be
continued; where the paths that lead back from all of these meet, the tokens
before are stable and are emitted. The merge list bounds how far back that
meeting can lie (``sufficient_lookahead``): a border moves only if a rule of
lower rank takes the token to its right, which frees the token to its left
for a rule of higher rank, and so on, along a chain of rules with rising rank
in which each rule's right part is the left part of the one before.

Every pre-token is encoded by this transducer; the ids of words and pre-tokens
below ``LONG`` bytes are kept in a bounded memo, for one task. A text is read in slices that
end at white space, and the runs of ids go on as they come. Beyond the text
itself, memory grows only with its longest word, which is normalised whole.

Decoding takes runs of ids, maps them to pieces in blocks and feeds their bytes
to an incremental UTF-8 state machine, so that a block may end inside a character.

Defined cases: a null or empty text has no tokens and decodes to the empty
string; strings of special tokens are recognised as the tokenizers library
does it; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WORD_GAP, prepare, release

#: Entries of a worker's memo of words, and as many that it had before; it starts anew when full.
MEMO = 200_000
#: Bytes from which on a word or pre-token is never in the memo.
LONG = 256
#: Characters or ids handled at a time.
BLOCK = 1 << 16
#: Added to a byte that ends a word, to make its symbol.
FINAL = 0x200

#: From here on the library's tables decide what is a letter.
LATIN_END = "\u0250"

#: Marks that, alone after letters, are a pre-token of their own.
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = regex.compile(r"\p{White_Space}+")
_GAP = re.compile(WORD_GAP)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters stand for themselves, the others are moved
    up from 256 in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Merges:
    """A BPE vocabulary with its merge list, as ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}  # rank of the rule that makes a token
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.vocab[a + b]
            self.rank[self.vocab[a], self.vocab[b]] = r
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (self.vocab[a], self.vocab[b]), r
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]               # a byte inside a word
        self.final = [self.vocab[c + self.suffix] for c in alphabet]  # a word's last byte
        # tokens by the symbols that they are made of, one character a symbol
        sign = {t: chr(b) for b, t in enumerate(self.inner)} | {t: chr(b + FINAL) for b, t in enumerate(self.final)}
        if not self.suffix:
            sign = {t: chr(b) for b, t in enumerate(self.inner)}
        for t in sorted(self.parts, key=self.born.__getitem__):
            a, b = self.parts[t]
            sign[t] = sign[a] + sign[b]
        self.spelled = {s: t for t, s in sign.items()}
        self.longest = max(map(len, self.spelled))
        self._known: dict[int, dict[int | None, bool]] = {t: {} for t in self.spelled.values()}
        self._n_known = 0
        self._automaton()
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        if any(self.born.get(x, -1) >= r for (a, b), r in self.rank.items() for x in (a, b)):
            raise ValueError("a merge rule ranks before the rules that make its parts")

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the rule that takes it) along one edge of a token's tree."""
        out, taken = [(token, 1 << 60)], None
        while token in self.parts:
            taken, token = self.born[token], self.parts[token][side]
            out.append((token, taken))
        return out

    def _automaton(self) -> None:
        """States are the beginnings of tokens: the longest that the symbols read
        so far end in. ``step``: by symbol, the state one symbol longer; ``link``:
        the next shorter state; ``ends``: the tokens that end there, longest first,
        as (token, symbols, which tokens can stand before it)."""
        none: dict[int, int] = {}  # of states that nothing continues
        self.step, self.link, self.ends = [none], [0], [()]
        step, link, ends, own, level = self.step, self.link, self.ends, {}, {0: []}
        for s, t in self.spelled.items():
            at = 0
            for k, c in enumerate(map(ord, s)):
                to = step[at].get(c)
                if to is None:
                    to = len(step)
                    if step[at] is none:
                        step[at] = {}
                    step[at][c] = to
                    step.append(none)
                    link.append(0)
                    ends.append(())
                    level.setdefault(k, []).append((at, c, to))
                at = to
            own[at] = (t, len(s), self._known[t])
        for k in sorted(level):
            for at, c, to in level[k]:
                x = at
                while x:
                    x = link[x]
                    found = step[x].get(c)
                    if found is not None:
                        link[to] = found
                        break
                rest = ends[link[to]]
                ends[to] = (own[to], *rest) if to in own else rest

    def stable(self, a: int | None, b: int) -> bool:
        """Whether a and b can stand side by side in an encoding; a is -1 where
        b is the first token, None where no encoding ends."""
        known = self._known[b].get(a)
        if known is None:
            if self._n_known > MEMO:
                for pairs in self._known.values():
                    pairs.clear()
                self._n_known = 0
            self._n_known += 1
            known = self._known[b][a] = a == -1 or a is not None and self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        if a not in self._right:
            self._right[a] = self._spine(a, 1)
        if b not in self._left:
            self._left[b] = self._spine(b, 0)
        rank = self.rank
        for x, x_taken in self._right[a]:
            for y, y_taken in self._left[b]:
                r = rank.get((x, y))
                # of equal ranks the one further left goes first
                if r is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    @functools.cached_property
    def sufficient_lookahead(self) -> int:
        """Symbols after which no reading further on can move a border."""
        chain: dict[int, int] = {}  # by left part: longest chain of rules so far
        longest = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            n = 1 + chain.get(b, 0)
            longest = max(longest, n)
            chain[a] = max(chain.get(a, 0), n)
        return (longest + 1) * self.longest

    def stream(self, word: bytes) -> Iterator[list[int]]:
        """The tokens of one pre-token, in runs that are emitted as they
        become stable; memory does not grow with the pre-token."""
        step, link, ends, stable = self.step, self.link, self.ends, self.stable
        window = max(2 * self.sufficient_lookahead, 4096)
        last: list[int | None] = [-1]  # last[i]: last token of the prefix that ends i symbols on; before all others the token emitted last
        size: list[int] = [0]
        state = 0
        for c in chain(word[:-1], (b + FINAL * bool(self.suffix) for b in word[-1:])):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                to = step[state].get(c)
            state = to or 0
            i = len(last)
            for t, n, known in ends[state]:
                p = last[i - n]
                ok = known.get(p)
                if ok or ok is None and stable(p, t):
                    last.append(t)
                    size.append(n)
                    break
            else:  # no encoding ends here (cannot happen while all bytes are tokens)
                last.append(None)
                size.append(0)
            if i >= window:
                paths = {j for j in range(i - self.longest + 1, i + 1) if j >= 0 and last[j] is not None}
                while len(paths) > 1:
                    j = max(paths)
                    paths.remove(j)
                    paths.add(j - size[j])
                meet = paths.pop()
                if meet > 0:
                    run, j = [], meet
                    while j > 0:
                        run.append(last[j])
                        j -= size[j]
                    run.reverse()
                    last, size = last[meet:], [0, *size[meet + 1:]]
                    yield run
        run, j = [], len(last) - 1
        while j > 0:
            run.append(last[j])
            j -= size[j]
        run.reverse()
        yield run

    def tokens(self, word: bytes) -> list[int]:
        """The tokens of one pre-token."""
        return [t for run in self.stream(word) for t in run]


class Memo(dict):
    """Word to ids, worked out where missing. When full, it starts anew, with
    what is asked for again of the entries before."""

    def __init__(self, work):
        self.work, self.before = work, {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.before.get(word)
        if got is None:
            got = self.work(word)
        if len(word) < LONG:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.before = {}


class Parting:
    """A text's words into pre-tokens, as the tokenizer file has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        steps = self.spec["normalizer"]["normalizers"]
        split, level = self.spec["pre_tokenizer"]["pretokenizers"]
        known = ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split"
                 and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel"
                 and not level["add_prefix_space"] and not level["use_regex"])
        if not known:
            raise ValueError("a tokenizer file of another kind")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.lettered = split["pattern"]["Regex"] == _LETTERS and all("<" in x["content"] for x in self.spec["added_tokens"])
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # other scripts' letters: parted by the library's own tables of characters
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.back = {c: b for b, c in enumerate(byte_alphabet())}

    def spans(self, text: str) -> Iterator[str]:
        """Ordinary text and special tokens in turn."""
        at = 0
        if self.special_at and "<" in text:
            for found in self.special_at.finditer(text):
                yield text[at: found.start()]
                yield found[0]
                at = found.end()
        yield text[at:]

    def plain(self, word: bytes) -> list[bytes] | None:
        """The pre-tokens of a word of Latin letters with at most one mark after
        them; None for any other word. Letters below ``LATIN_END`` are their own
        normal form."""
        mark = word[-1:]
        body = word[:-1] if mark in MARKS else word
        if not self.lettered:
            return None
        if body.isalpha():
            shown = body.lower()
        elif body.isascii():
            return None
        else:
            text = body.decode("utf-8", "replace")
            low = text.lower()
            if not (text.isalpha() and low.isalpha()) or max(text) >= LATIN_END:
                return None
            shown = low.encode()
        return [shown] if body is word else [shown, mark]

    def parted(self, text: str) -> list[bytes]:
        """The pre-tokens of a word without special tokens."""
        return list(self.each(text))

    def each(self, text: str) -> Iterator[bytes]:
        if text.isascii() or max(text) < LATIN_END:
            shown = text.lower() if text.isascii() else _SPACE.sub(" ", unicodedata.normalize("NFC", text)).lower()
            if len(shown) < LONG:
                yield from map(str.encode, self.pattern.findall(shown))
            else:
                for found in self.pattern.finditer(shown):
                    yield found[0].encode()
            return
        normal, part = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        for x, _ in part(normal(text)):
            yield bytes(map(self.back.__getitem__, x))


class Encoder:
    """Text to ids as the tokenizers library does with the same file."""

    def __init__(self, path: str):
        self.parting = Parting(path)
        self.merges = Merges(self.parting.spec)
        self.memo, self.pieces = Memo(self._word), Memo(self._piece)

    def _piece(self, raw: bytes) -> bytes:
        ids = self.merges.tokens(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        parts = self.parting.plain(word)
        if parts is None:
            return b"".join(self.runs(word))
        return self.pieces[parts[0]] if len(parts) == 1 else b"".join([self.pieces[p] for p in parts])

    def runs(self, word: bytes) -> Iterator[bytes]:
        """The ids of a word, those of a long pre-token as they become stable."""
        pieces, parting = self.pieces, self.parting
        for i, span in enumerate(parting.spans(word.decode("utf-8", "replace"))):
            if i % 2:
                yield np.array([parting.special[span]], "<u4").tobytes()
                continue
            for raw in parting.each(span):
                if len(raw) < LONG:
                    yield pieces[raw]
                else:
                    for run in self.merges.stream(raw):
                        yield np.array(run, "<u4").tobytes()

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """The ids of a whole text as little-endian 32-bit integers, in runs.
        White space never joins or parts tokens, so each word is encoded by
        itself."""
        text, at, memo = text or "", 0, self.memo
        while at < len(text):
            gap = _GAP.search(text, at + BLOCK)
            end = gap.end() if gap else len(text)
            words = text[at:end].encode("utf-8", "replace").split()
            at = end
            if max(map(len, words), default=0) < LONG:
                yield b"".join(map(memo.__getitem__, words))
                continue
            run = bytearray()
            for word in words:
                for raw in self.runs(word) if len(word) >= LONG else (memo[word],):
                    run += raw
                    if len(run) >= BLOCK:
                        yield bytes(run)
                        run.clear()
            yield bytes(run)

    def forget(self) -> None:
        """Let the memos go, at the end of a task: the worker and its encoder stay
        through stages that do not encode."""
        self.memo.forget()
        self.pieces.forget()
        release()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), "<u4")


class Decoder:
    """Ids to text: the pieces' bytes, through an incremental UTF-8 machine.

    ``joiner``: what the library puts between pieces. A file that names no
    decoder has its pieces joined by a space, as they stand in the vocabulary;
    with ``plain`` the byte alphabet is undone and a word's end is a space."""

    def __init__(self, path: str, plain: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") and not plain:
            raise ValueError("a tokenizer file with a decoder of its own")
        ids = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        back = {c: b for b, c in enumerate(byte_alphabet())}

        def piece(t: str) -> bytes:
            if not plain:
                return t.encode()
            end = bool(suffix) and t.endswith(suffix)
            body = t[: -len(suffix)] if end else t
            return bytes(back.get(c, 63) for c in body) + b" " * end

        self.joiner = b"" if plain else b" "
        self.table = [piece(ids[i]) if i in ids else None for i in range(max(ids) + 1)]

    def stream(self, runs: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of ids that come in runs."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, joiner, between = self.table, self.joiner, b""
        for ids in runs:
            for at in range(0, len(ids), BLOCK):
                raw = joiner.join(map(table.__getitem__, ids[at: at + BLOCK].tolist()))
                yield machine.decode(between + raw)
                between = joiner
        yield machine.decode(b"", True)

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream([ids]))


def digests(text: str | None, enc: Encoder, dec: Decoder) -> tuple[int, str, str]:
    """(n_tokens, digest of the ids, digest of the text they decode to); each
    run of ids is counted, hashed and decoded as it comes."""
    n, ids, shown = 0, hashlib.sha256(), hashlib.sha256()

    def runs() -> Iterator[np.ndarray]:
        nonlocal n
        for raw in enc.blocks(text):
            n += len(raw) // 4
            ids.update(raw)
            yield np.frombuffer(raw, "<u4")

    for part in dec.stream(runs()):
        shown.update(part.encode())
    return n, ids.hexdigest(), shown.hexdigest()


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with a binary column: the ids as little-endian 32-bit integers."""
    prepare(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        try:
            for texts in batches:
                yield pd.Series([b"".join(enc.blocks(t)) for t in texts], dtype=object)
        finally:
            enc.forget()

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode_ids(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text that its binary ids decode to (null ids: empty)."""
    prepare(tokens.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dec = decoder(tokenizer)
        for rows in batches:
            yield pd.Series([dec.decode(np.frombuffer(x or b"", "<u4")) for x in rows], dtype=object)

    return tokens.withColumn(out_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the digests of its ids and of the text
    that they decode to. Encoded and decoded in one pass: neither the ids nor
    the decoded text leave the worker."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc, dec = encoder(tokenizer), decoder(tokenizer)
        try:
            for texts in batches:
                yield pd.DataFrame([digests(t, enc, dec) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            enc.forget()

    out = docs.select(F.col(id_col).alias("_id"), told(F.col(text_col)).alias("_d"))
    return out.select(F.col("_id").alias(id_col), "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
