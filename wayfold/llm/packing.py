"""Best-fit packing of tokenised documents into sequences of one length, by minimum bin slack.

Documents become pieces: one of what doesn't fill a sequence, and full ones. What is left to decide depends on the pieces'
lengths alone, of which there are no more than a sequence has tokens: their counts go to the driver. There each bin takes
the largest piece left and then the fullest feasible combination of the lengths that are left, found by subset sums on a
bit set; a combination is taken as often as the counts allow. Pieces find their places by their number among those of
their length, which is counted task by task, so that no length is numbered in one task.

Defined results: a null text is empty; an empty text is the closing id alone; repeated rows are documents of their own; a
null id is kept; texts of any length are cut into pieces; an empty table gives no rows. Other columns of the table are
not looked at, whatever their names are.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, tidy

SEQUENCE = 2048
END = 0
#: Texts beyond this many characters go to the tokenizers library, whose word search has no limit of steps.
FAST_CHARS = 1 << 19
#: Texts (by characters) that the library encodes together.
BATCH_CHARS = 1 << 20


@lru_cache(maxsize=1 << 16)
def settled(char: str) -> bool:
    """Whether all libraries' tables agree on a character; they may not on those that Unicode assigned lately or not yet."""
    return unicodedata.category(char) != "Cn"


class Tokens:
    """Ids of texts as the tokenizers library gives them. ``ranks``, the same vocabulary as tiktoken reads it, is some four
    times faster and takes the texts on which both agree: without special tokens and unassigned characters, not too long."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(f"packing-{len(table)}", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def same(self, text: str) -> bool:
        return self.fast is not None and len(text) <= FAST_CHARS and not any(s in text for s in self.special) and (text.isascii() or all(map(settled, set(text))))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        quick = [self.same(t) for t in texts]
        rest = iter(self.slow.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        for t, q in zip(texts, quick):
            yield np.array(self.fast.encode_ordinary(t) if q else next(rest).ids, dtype="<u4")


def cut(n: int, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of n tokens; only the first may be shorter than a sequence."""
    k = -(-n // most)
    start = np.maximum(0, n - most * np.arange(k, 0, -1))
    return start, np.diff(np.append(start, n))


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", most: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the piece's number among those of its length in its task."""

    def run(batches):
        tokens, seen, part = Tokens(path, ranks), np.zeros(most + 1, np.int64), TaskContext.get().partitionId()
        closing = np.array([end], "<u4")
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").fill_null("")
            size, lo = np.asarray(pa.compute.utf8_length(texts)), 0
            reach = np.cumsum(size)
            while lo < len(texts):
                before = reach[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(reach, before + BATCH_CHARS, "right")))
                rows: list[tuple] = []
                for k, codes in enumerate(tokens.encode(texts.slice(lo, hi - lo).to_pylist())):
                    codes = np.append(codes, closing)
                    start, length = cut(len(codes), most)
                    for i, (a, n) in enumerate(zip(start.tolist(), length.tolist())):
                        rows.append((lo + k, i, a, n, zlib.crc32(codes[a : a + n].tobytes()), int(seen[n])))
                        seen[n] += 1
                at, *cols = zip(*rows)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *arrays[:4], pa.array([part] * len(at), pa.int32()), arrays[4]], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
                lo = hi
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def fullest(counts: np.ndarray, room: int, most: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination of the lengths left that comes nearest to ``room``: subset sums on a bit set,
    long lengths first, until the room can be filled."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in range(min(room, most), 0, -1):
        left, batch = min(int(counts[n]), room // n), 1
        while left > 0:  # 1, 2, 4 ... of a length make any number of it
            take = min(batch, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, batch = left - take, batch * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + take
            total -= n * take
    return sorted(out.items(), reverse=True)


def plan(counts: np.ndarray, most: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """How bins are filled, from the pieces of each length: (length, low, high, in_bin, first_bin, offset). Pieces low to
    high - 1 of a length lie in bins from first_bin on, in_bin of them each from offset on. The list's size follows from
    ``most``, whatever the counts are."""
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    out, bins, top = [], 0, most
    while top > 0:
        if not left[top]:
            top -= 1
            continue
        left[top] -= 1
        chosen = fullest(left, most - top, most)
        left[top] += 1
        mix = dict(chosen)
        mix[top] = mix.get(top, 0) + 1
        times = min(int(left[n]) // k for n, k in mix.items())
        offset = 0
        for n, k in sorted(mix.items(), reverse=True):
            out.append((n, int(used[n]), int(used[n]) + k * times, k, bins, offset))
            offset += n * k
            used[n] += k * times
            left[n] -= k * times
        bins += times
    return out


def pack(docs: DataFrame, path: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", most: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place."""
    spark = docs.sparkSession
    made = durable(pieces(docs, path, ranks, doc_id, text, most, end))
    held = durable(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(most + 1, np.int64)
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # ``most`` rows
        counts[r.length] = r.n
    segments = spark.createDataFrame(plan(counts, most) or [(0, 0, 0, 1, 0, 0)], "length int, low long, high long, in_bin long, first_bin long, offset long")
    # what the tasks before hold of a length: a row for each task
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = made.join(held.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    where = (F.col("s.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = numbered.alias("p").join(F.broadcast(segments.alias("s")), where)  # a plan's size follows from ``most``
    at = F.col("rank") - F.col("low")
    nth_bin = F.floor(at / F.col("in_bin")).cast("long")
    return placed.select("doc_id", "piece", "start", F.col("p.length").cast("long").alias("length"), "ids_crc32", (F.col("first_bin") + nth_bin).alias("sequence_id"), (F.col("offset") + (at - nth_bin * F.col("in_bin")) * F.col("p.length")).alias("offset"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
