"""BPE encoding and decoding as streaming transducers.

The merge list fixes a lookahead: no symbol further on can move a token boundary that far back. The encoder keeps a
window of that size, emits tokens once they are stable, and so needs constant memory for words of any length: each
word goes through it, and ids flow on to both digests as they become stable. What it gave for a short word is
remembered, so that frequent words are merged once. The decoder turns token bytes into text with an incremental UTF-8
state machine.

Defined results: a null text counts as empty and has no tokens; repeated rows get equal digests; an empty table gives
no rows; texts may have any length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tidy

#: Short pieces and words whose tokens a task remembers; a table is emptied when full.
MEMO = 100_000
MEMO_CHARS = 64
#: Characters of a text that are cut into pieces at once.
BLOCK = 1 << 16
#: Symbols a window takes in between two emissions.
STEP = 256
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NONE = 1 << 62
_BLANKS = re.compile("[ \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PY_ONLY = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1 << 16)
def unsettled(char: str) -> bool:
    """Whether Python's tables don't have a character. The regex package's and the vocabulary's library's may, and do not
    agree on which of these are letters and digits, nor on their case."""
    return unicodedata.category(char) == "Cn"


class Merges:
    """A vocabulary file's tokens, merge rules, word pattern and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    @cached_property
    def tokens(self) -> list[str]:
        out = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            out[i] = t
        return out

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        """For each pair of ids its rule: the rank above, the joined token's id in the ID_BITS below."""
        v = self.vocab
        return {(v[a], v[b]): r << ID_BITS | v[a + b] for r, (a, b) in enumerate(self.rules)}

    @cached_property
    def lookahead(self) -> int:
        """Symbols after which a token boundary can't move any more.

        Let a text grow on its right. A rule (u, v) can move the last common boundary left only by joining the common
        token u to a token v on the other side, so by |u|, and once. The next such rule comes later in the list, and
        its right side starts where u starts: u stands on the chain of first parts of it. The longest such chain,
        taken from the last rule to the first, bounds the whole move.
        """
        first = {a + b: a for a, b in self.rules}
        size: dict[str, int] = {}
        for a, b in self.rules:
            size[a + b] = size.get(a, 1) + size.get(b, 1)
        reach: dict[str, int] = {}
        longest = 1
        for u, v in reversed(self.rules):
            far = size.get(u, 1) + reach.get(u, 0)
            longest = max(longest, far)
            t: str | None = v
            while t is not None:
                reach[t] = max(reach.get(t, 0), far)
                t = first.get(t)
        return longest


def merge(ids: list[int], ranks: dict) -> list[int]:
    """Apply the rule of lowest rank at its first place until none fits; only the two pairs beside it change."""
    get = ranks.get
    pairs = [get(p, NONE) for p in zip(ids, ids[1:])]
    while pairs:
        best = min(pairs)
        if best == NONE:
            break
        i = pairs.index(best)
        ids[i] = new = best & ID_MASK
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get((new, ids[i + 1]), NONE)
        if i:
            pairs[i - 1] = get((ids[i - 1], new), NONE)
    return ids


class Encoder:
    """feed() bytes of a word, get stable tokens; finish() ends the word. stream() does whole texts."""

    def __init__(self, merges: Merges, memo: int = MEMO, step: int = STEP):
        self.m, self.memo_size, self.step = merges, memo, step
        self.look, self.ranks = merges.lookahead, merges.ranks
        symbols = byte_symbols()
        self.inner = [merges.vocab[s] for s in symbols]
        self.last = [merges.vocab[s + merges.end] for s in symbols]
        self.lengths = [1] * len(merges.tokens)
        for (a, b), rule in self.ranks.items():
            self.lengths[rule & ID_MASK] = self.lengths[a] + self.lengths[b]
        self.words = regex.compile(merges.pattern)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.words_seen: dict[str, tuple[int, ...]] = {}
        self.window: list[int] = []
        self.held: int | None = None

    def feed(self, piece: bytes) -> list[int]:
        """Take in some bytes of a word; the tokens that are stable now."""
        if self.held is None and len(piece) <= self.step:  # a word's beginning, often the whole word
            self.window = [*map(self.inner.__getitem__, piece[:-1])]
            self.held = piece[-1]
            return []
        out: list[int] = []
        for i in range(0, len(piece), self.step):
            part = piece[i : i + self.step]
            if self.held is not None:
                self.window.append(self.inner[self.held])
            self.held = part[-1]  # whether it ends the word is not known yet
            self.window += map(self.inner.__getitem__, part[:-1])
            if len(self.window) > self.look + self.step:
                stable, end = len(self.window) - self.look, 0
                for t in merge(self.window[:], self.ranks):
                    if end + self.lengths[t] > stable:
                        break
                    end += self.lengths[t]
                    out.append(t)
                self.window = self.window[end:]
        return out

    def finish(self) -> list[int]:
        """End the word: the tokens that are left."""
        if self.held is not None:
            self.window.append(self.last[self.held])
        out = merge(self.window, self.ranks)
        self.window, self.held = [], None
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of a short word; what the transducer gave is remembered."""
        ids = self.words_seen.get(word)
        if ids is None:
            self.feed(word.encode("utf-8", "replace"))
            ids = tuple(self.finish())
            if len(self.words_seen) >= self.memo_size:
                self.words_seen.clear()
            self.words_seen[word] = ids
        return ids

    def long_word(self, word: str):
        """Tokens of a word of any length, as they become stable."""
        for i in range(0, len(word), self.step):
            yield self.feed(word[i : i + self.step].encode("utf-8", "replace"))
        yield self.finish()

    def words_of(self, part: str):
        """The words of text without special tokens, normalised. Where it has characters that came to Unicode lately or are
        not there yet, the vocabulary's library normalises and cuts it, by its own tables."""
        if not part.isascii() and any(map(unsettled, set(part))):
            yield from (word for word, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part)))
            return
        if not part.isascii() and not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        for found in self.words.finditer(part.replace("Σ", "σ").lower()):
            yield found[0]

    @cached_property
    def normal(self):
        from tokenizers import normalizers

        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    @cached_property
    def cut(self):
        from tokenizers import Regex, pre_tokenizers

        return pre_tokenizers.Split(Regex(self.m.pattern), "removed", invert=True)

    def pieces(self, piece: str):
        """Token runs of a piece between blanks: special tokens, and the words of the pattern."""
        for part in self.specials.split(piece) if self.specials and "<" in piece else (piece,):
            if part in self.m.special:
                yield (self.m.special[part],)
                continue
            for word in self.words_of(part):
                if len(word) <= MEMO_CHARS:
                    yield self.word(word)
                else:
                    yield from self.long_word(word)

    def piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of a short piece."""
        low = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        low = low.lower()
        if low.isalpha():  # one word as it is
            return self.word(low)
        if low[:-1].isalpha() and low[-1] in ".,!":
            return self.word(low[:-1]) + self.word(low[-1])
        return tuple(t for run in self.pieces(piece) for t in run)

    def stream(self, text: str):
        """Token runs of a text, in order. Beside the text and its longest piece between blanks (to normalise it), memory
        holds a block of pieces, the window and the tables."""
        memo, lo = self.memo, 0
        while lo < len(text):
            cut = _BLANKS.search(text, lo + BLOCK) if lo + BLOCK < len(text) else None
            hi = cut.start() if cut else len(text)
            block = text[lo:hi] if lo or cut else text
            for piece in block.split() if not _PY_ONLY.search(block) else filter(None, _BLANKS.split(block)):
                ids = memo.get(piece)
                if ids is not None:
                    yield ids
                elif len(piece) > MEMO_CHARS:
                    yield from self.pieces(piece)
                else:
                    ids = self.piece(piece)
                    if len(memo) >= self.memo_size:
                        memo.clear()
                    memo[piece] = ids
                    yield ids
            lo = hi if cut else len(text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for ids in self.stream(text or ""):
            out += ids
        return out


def open_tail(raw: bytes) -> int:
    """Bytes at the end of raw (0 to 3) that begin a UTF-8 character and are valid so far, but don't end it."""
    for back in range(1, min(3, len(raw)) + 1):
        lead = raw[-back]
        if lead & 0xC0 == 0x80:
            continue
        need = 2 if 0xC2 <= lead <= 0xDF else 3 if lead & 0xF0 == 0xE0 else 4 if 0xF0 <= lead <= 0xF4 else 1
        if need <= back:
            return 0
        if back > 1:  # the second byte has a narrower range after some lead bytes
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
            if not low <= raw[1 - back] <= high:
                return 0
        return back
    return 0


class Decoder:
    """push() ids, get the text that is complete; finish() flushes. Invalid bytes become U+FFFD.

    State: the bytes of a character that isn't complete yet (three at most), and whether a token came before.
    spaced: as a vocabulary file without a decoder is decoded, the tokens' printed forms joined by one blank.
    Otherwise the bytes that the tokens stand for, with one blank after each end of a word.
    """

    def __init__(self, merges: Merges, spaced: bool = True):
        if spaced:
            self.bytes = [t.encode() for t in merges.tokens]
        else:
            value = {s: b for b, s in enumerate(byte_symbols())}
            ends = len(merges.end)
            plain = lambda t: t[:-ends] if ends and t.endswith(merges.end) else t
            blank = lambda t: b" " * bool(ends and t.endswith(merges.end))
            self.bytes = [bytes(value[c] for c in plain(t)) + blank(t) if t in merges.vocab else t.encode() for t in merges.tokens]
        self.joint = b" " if spaced else b""
        self.reset()

    def reset(self) -> None:
        self.held, self.begun = b"", False

    def push(self, ids) -> str:
        raw = self.joint.join(map(self.bytes.__getitem__, ids))
        if self.begun and ids:
            raw = self.joint + raw
        self.begun |= bool(ids)
        return self.push_bytes(raw)

    def push_bytes(self, raw: bytes) -> str:
        raw = self.held + raw
        tail = open_tail(raw)
        self.held = raw[len(raw) - tail :]
        return raw[: len(raw) - tail].decode("utf-8", "replace")

    def finish(self) -> str:
        out = self.held.decode("utf-8", "replace")
        self.reset()
        return out


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Token ids that go to the digests at once.
FLUSH = 4096


def digest(text: str, encoder: Encoder, decoder: Decoder, numbers: list[str]) -> tuple[int, str, str]:
    """Number of tokens and both digests of a text; the ids flow through, they are never held together."""
    ids_sha, text_sha, n, run = hashlib.sha256(), hashlib.sha256(), 0, []

    def flush():
        nonlocal n, run
        ids_sha.update((" " * (n > 0) + " ".join(map(numbers.__getitem__, run))).encode())
        text_sha.update(decoder.push(run).encode())
        n, run = n + len(run), []

    for ids in encoder.stream(text):
        run += ids
        if len(run) >= FLUSH:
            flush()
    if run:
        flush()
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def digests(spark: SparkSession, path: str):
    """A vectorised column function: text -> struct(n_tokens, ids_sha256, decoded_sha256). The tables live as long as
    the task."""
    shared = spark.sparkContext.broadcast(Merges(path))  # of the vocabulary file's size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        encoder, decoder, numbers = Encoder(m), Decoder(m), [str(i) for i in range(len(m.tokens))]
        for texts in batches:
            rows = [digest(t if isinstance(t, str) else "", encoder, decoder, numbers) for t in texts]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        del encoder, decoder, numbers
        tidy()

    return F.pandas_udf(run, DIGEST).asNondeterministic()


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with an array column of token ids (null or empty text: an empty array)."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for texts in batches:
            yield pd.Series([encoder.encode(t if isinstance(t, str) else "") for t in texts])

    return docs.withColumn(out, F.pandas_udf(run, "array<int>")(F.col(text)))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (a null text counts as empty)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), digests(docs.sparkSession, path)(F.col(text)).alias("t"))
    return d.select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return token_digests(read(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
