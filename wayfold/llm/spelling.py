"""Grouping of spelling variants by Bloom-guided neighbourhoods.

The vocabulary (words of enough length and number) fills blocked Bloom filters, one for each word length. Every word
generates its edits of one code point as hashes, each derived from the word's in one step, and probes the filter of the
edit's length; an edit becomes a string only where the filter has it. These few meet the vocabulary in an exact join, which
takes the false positives out. Near words come in pairs, so that one side of each is enough to generate: deletions (the
other side's insertions), and replacements by a larger code point.

Filters are broadcast in rounds of at most FILTER_BYTES; a length whose words need more is dealt over several rounds by the
words' hashes, and each round probes what its own filters may hold. So what a task holds has a bound at any vocabulary.

Defined results: null and empty texts have no words; a null id counts as an empty one where runs are altered; texts and
words may have any length; repeated rows count each; an empty table gives no rows. Other columns of the table are not
looked at, whatever their names are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, durable, mix64, read, tidy

MIN_CHARS = 5
MIN_COUNT = 3
#: One run in ERROR_RATE loses a code point.
ERROR_RATE = 97
#: A form has at least so many times the occurrences of its word.
FORM_RATIO = 2
#: Distinct words and bytes of them that a task counts before it hands them on.
COUNTED = 200_000
COUNTED_BYTES = 16 << 20
#: Bits of filter a word, lanes (a bit each) of a block of 64-bit words; bytes of all filters of a round.
BITS = 16
LANES = 8
FILTER_BYTES = 32 << 20
#: Hashed edits that a task probes at once, and bytes of found edits that it hands on together.
PROBES = 1 << 20
FOUND_BYTES = 4 << 20
MAX_DOUBLINGS = 8

_LETTERS = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_CHARS)
_BASE = U64(0x9E3779B97F4A7C15)
_MULTIPLES = [U64(int(v) | 1) for v in np.random.default_rng(12).integers(1, 2**62, LANES)]
_BLOCK_BYTES = LANES * 8


def runs(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters that can give a word, a byte a code point: all letters lie below U+0100."""
    return _LETTERS.findall(text.encode("latin-1", "replace").lower())


def altered(run: bytes, prefix: int) -> bytes:
    """The run, without one code point where the error rate says so; prefix: crc32 of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % ERROR_RATE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches):
    total: Counter = Counter()
    size = 0

    def out():
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for i, text in zip(b.column("id").to_pylist(), b.column("text")):
            text = text.as_py()
            if not text:
                continue
            prefix = zlib.crc32(f"{i}:".encode())
            for run, n in Counter(runs(text)).items():
                word = altered(run, prefix)
                if len(word) >= MIN_CHARS:
                    size += 0 if word in total else len(word)
                    total[word] += n
            if len(total) >= COUNTED or size >= COUNTED_BYTES:
                yield from out()
                total.clear()
                size = 0
    yield from out()
    total.clear()
    tidy()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n (occurrences) of the words of enough length and number. Tasks count before words shuffle."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def plain_hash(codes: np.ndarray) -> np.ndarray:
    """Polynomials of the words of one length (rows of code points)."""
    return ((codes.astype(U64) + U64(1)) * powers(codes.shape[1])[1:]).sum(1, dtype=U64)


def share_of(h: np.ndarray, shares: int) -> np.ndarray:
    """The share of a length's words that a hashed word belongs to."""
    return (mix64(h ^ U64(0x5851F42D4C957F2D)) % U64(shares)).astype(np.int64)


class Filter:
    """A blocked Bloom filter of hashed words: a block is LANES words of 64 bits, and a key sets a bit in each."""

    def __init__(self, words: int):
        self.blocks = max(1, -(-words * BITS // (_BLOCK_BYTES * 8)))
        self.bits = np.zeros((self.blocks, LANES), U64)

    @staticmethod
    def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
        return U64(1) << ((h * _MULTIPLES[lane]) >> U64(58))

    def add(self, h: np.ndarray) -> None:
        h = mix64(h)
        block = (h % U64(self.blocks)).astype(np.int64)
        for lane in range(LANES):
            np.bitwise_or.at(self.bits[:, lane], block, self.lane_bit(h, lane))

    def has(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the filter; each lane looks at what the lanes before left."""
        h = mix64(h)
        block, at = (h % U64(self.blocks)).astype(np.int64), np.arange(len(h))
        for lane in range(LANES):
            at = at[(self.bits[block[at], lane] & self.lane_bit(h[at], lane)) != 0]
        return at


def rounds(lengths: dict[int, int], most: int = FILTER_BYTES) -> list[list[tuple[int, int, int]]]:
    """(length, share, shares) of the filters of each round, by the words of each length; a round's filters hold ``most``
    bytes together, or one block."""
    out, room = [], 0
    for n in sorted(lengths):
        size = (lengths[n] * BITS // 8 // _BLOCK_BYTES + 1) * _BLOCK_BYTES
        shares = -(-size * 5 // (most * 4)) if size > most else 1  # shares by hash differ a little in size
        for share in range(shares):
            need = size // shares
            if not out or need > room:
                out.append([])
                room = most
            out[-1].append((n, share, shares))
            room -= need
    return out


def by_length(words: list[str]):
    """Code points of the words of each length, with the words' positions; in slices of about FOUND_BYTES."""
    at = defaultdict(list)
    for i, w in enumerate(words):
        at[len(w)].append(i)
    for n, rows in at.items():
        step = max(1, FOUND_BYTES // n)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield n, np.array(part), np.frombuffer("".join(words[i] for i in part).encode("latin-1"), np.uint8).reshape(len(part), n)


def build_filters(vocab: DataFrame, lengths: dict[int, int], kinds: list[tuple[int, int, int]]) -> dict:
    """The filters of one round: tasks fill partial ones, blocks of which are joined by key; the round's bytes, which have
    a bound, come to the driver."""
    shares = {n: k for n, _, k in kinds}
    sizes = {(n, share): -(-lengths[n] // k) for n, share, k in kinds}
    wanted = set(sizes)

    def run(batches):
        held = {}
        for b in batches:
            for n, _, codes in by_length(b.column("word").to_pylist()):
                h = plain_hash(codes)
                share = share_of(h, shares[n])
                for s in np.unique(share):
                    if (n, s) in wanted:
                        held.setdefault((n, int(s)), Filter(sizes[n, s])).add(h[share == s])
        for (n, s), f in held.items():
            for lo in range(0, f.blocks, 1024):
                part = f.bits[lo : lo + 1024]
                used = np.flatnonzero(part.any(1))
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([s], pa.int32()), pa.array([lo], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["size", "share", "low", "bits"])
        tidy()

    def join(rows: pa.Table) -> pa.Table:
        bits = np.frombuffer(rows.column("bits")[0].as_buffer(), U64).copy()
        for other in rows.column("bits")[1:]:
            bits |= np.frombuffer(other.as_buffer(), U64)
        first = rows.slice(0, 1)
        return pa.table([first.column("size"), first.column("share"), first.column("low"), pa.array([bits.tobytes()], pa.binary())], names=["size", "share", "low", "bits"])

    schema = "size int, share int, low int, bits binary"
    mine = vocab.where(F.length("word").isin(sorted(shares)))
    out = {key: Filter(n) for key, n in sizes.items()}
    for r in mine.select("word").mapInArrow(run, schema).groupBy("size", "share", "low").applyInArrow(join, schema).toLocalIterator():
        part = np.frombuffer(r.bits, U64).reshape(-1, LANES)
        out[r["size"], r.share].bits[r.low : r.low + len(part)] = part
    return out


def edits(codes: np.ndarray, alphabet: np.ndarray, deletions: bool, replacements: bool):
    """(row, place, letter, hash) of the edits of words of one length: without the code point at a place (letter -1; of
    equal neighbours the last), and with a larger letter there."""
    n = codes.shape[1]
    power = powers(n)[1:]
    values = codes.astype(U64) + U64(1)
    term = values * power
    whole = term.sum(1, dtype=U64)
    step = max(1, PROBES // max(1, len(codes)))
    if deletions:  # what follows moves one place ahead
        ahead = np.cumsum(term, axis=1, dtype=U64) - term
        moved = np.zeros_like(term)
        moved[:, 1:] = values[:, 1:] * power[:-1]
        behind = moved.sum(1, dtype=U64)[:, None] - np.cumsum(moved, axis=1, dtype=U64)
        last = np.ones(codes.shape, bool)
        last[:, :-1] = codes[:, :-1] != codes[:, 1:]
        for lo in range(0, n, step):
            row, at = np.nonzero(last[:, lo : lo + step])
            at = at + lo
            yield row, at, np.full(len(row), -1), ahead[row, at] + behind[row, at]
    if replacements:
        letters = alphabet.astype(U64) + U64(1)
        step = max(1, step // max(1, len(alphabet)))
        for lo in range(0, n, step):
            larger = alphabet[None, None, :] > codes[:, lo : lo + step, None]
            row, at, letter = np.nonzero(larger)
            at = at + lo
            yield row, at, alphabet[letter].astype(np.int64), whole[row] + (letters[letter] - values[row, at]) * power[at]


def candidates(vocab: DataFrame, filters: dict, kinds: list[tuple[int, int, int]], alphabet: np.ndarray) -> DataFrame:
    """word, n, near: edits of the vocabulary's words that a round's filters may hold."""
    shares = {n: k for n, _, k in kinds}
    shared = vocab.sparkSession.sparkContext.broadcast(filters)  # FILTER_BYTES at most

    def run(batches):
        for b in batches:
            words, counts = b.column("word").to_pylist(), b.column("n")
            rows, near, size = [], [], 0
            for n, at, codes in by_length(words):
                row_step = max(1, PROBES // (n * max(1, len(alphabet))))
                for lo in range(0, len(codes), row_step):
                    part, own = codes[lo : lo + row_step], at[lo : lo + row_step]
                    for row, place, letter, h in edits(part, alphabet, n - 1 in shares, n in shares):
                        length = n if len(letter) and letter[0] >= 0 else n - 1
                        for (kind, share), f in shared.value.items():
                            if kind != length:
                                continue
                            mine = np.flatnonzero(share_of(h, shares[length]) == share) if shares[length] > 1 else np.arange(len(h))
                            for k in mine[f.has(h[mine])]:
                                w, p, c = words[own[row[k]]], int(place[k]), int(letter[k])
                                rows.append(int(own[row[k]]))
                                near.append(w[:p] + (chr(c) if c >= 0 else "") + w[p + 1 :])
                                size += n
                                if size >= FOUND_BYTES:
                                    yield _found(b, counts, rows, near)
                                    rows, near, size = [], [], 0
            if rows:
                yield _found(b, counts, rows, near)
        tidy()

    touched = sorted({m for n in shares for m in (n, n + 1)})
    return vocab.where(F.length("word").isin(touched)).mapInArrow(run, "word string, n long, near string")


def _found(b: pa.RecordBatch, counts: pa.Array, rows: list[int], near: list[str]) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([b.column("word").take(at), counts.take(at), pa.array(near, pa.string())], names=["word", "n", "near"])


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words that one edit of a code point parts, each once. vocab: word, n, durable."""
    lengths = {r.size: r.n for r in vocab.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = vocab.sparkSession.createDataFrame([], "word string, n long, near string, near_n long")
    if not lengths:
        return empty
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()  # 256 at most
    alphabet = np.array(sorted(ord(r.c) for r in letters), np.uint8)
    out = None
    for kinds in rounds(lengths):
        found = candidates(vocab, build_filters(vocab, lengths, kinds), kinds, alphabet)
        known = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
        pairs = durable(found.join(known, "near").select("word", "n", "near", "near_n"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: pointers double until each ends. Forms grow in number, so they have no cycle."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_DOUBLINGS):  # a form has twice its word's number: 63 steps at most
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = durable(at.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at
    raise RuntimeError("forms have a cycle")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of the vocabulary's words (see the contract of the query)."""
    vocab = durable(vocabulary(docs, doc_id, text))
    pairs = near_pairs(vocab)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best, F.first("n").alias("n"))
    enough = -F.col("best.order") >= FORM_RATIO * F.col("n")
    near = durable(near.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")))
    root = roots(near.where("form is not null"))
    out = vocab.join(near, "word", "left").join(root, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
