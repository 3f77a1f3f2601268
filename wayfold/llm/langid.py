"""Language identification with language-bitmask n-gram filters.

A filter is an array of positions, each with one bit for every language (bit-sliced Bloom filters): the AND of the
words at an n-gram's positions holds all languages that contain the n-gram. Counts per language over a text,
corrected for each filter's false-positive rate, decide.

Defined results: a null text and one without a letter are ``und`` with score 0; where no n-gram is known the most
frequent learnt language is the answer, with score 0; of equal counts the first language by name wins; repeated rows get
equal answers; an empty table gives no rows, and without training rows every text is ``und``. Rows of training whose
language or text is null teach nothing.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, U64, durable, fold_of, free_name, mix64, read, text_slices, text_view, tidy

N = 4
HASHES = 4
#: Bounds of the training sample and of the model.
DOCS_PER_LANGUAGE = 2500
GRAMS_PER_LANGUAGE = 20_000
#: A stage rejects texts of which a smaller share of n-grams belongs to the language found.
MIN_HIT_RATE = 0.05

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit n-gram codes of all texts, n-grams before each text, and whether each text has a letter.

    Texts are lower-cased; runs of other characters than letters become one blank, and two blanks stand at both ends.
    """
    parts = ["  " + (t or "").lower() + "  " for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(parts)), size)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    start = end - size
    for shift in (0, 1):
        keep[start + shift] = True
    keep[end - 1] = True
    code = np.where(letter, code, 32).astype(U64)[keep]
    row = row[keep]
    has = np.bincount(row, np.where(code != 32, 1, 0), len(parts)) > 0
    if len(code) < N:
        return np.zeros(0, U64), np.zeros(len(parts) + 1, np.int64), has
    h = code[: len(code) - N + 1].copy()
    for j in range(1, N):
        h = h * U64(0x2545F4914F6CDD1D) + code[j : len(code) - N + 1 + j]
    inside = row[: len(code) - N + 1] == row[N - 1 :]
    h, row = mix64(h[inside]), row[: len(code) - N + 1][inside]
    return h, np.searchsorted(row, np.arange(len(parts) + 1)), has


def _positions(h: np.ndarray, mask: int):
    """Double hashing; an odd step keeps the positions apart."""
    step = (h >> U64(32)) | U64(1)
    for k in range(HASHES):
        yield ((h + U64(k) * step) & U64(mask)).astype(np.int64)


@dataclass
class MaskFilter:
    """words: positions x ceil(languages / 64), bit-sliced; langs in the order of their bits."""

    langs: list[str]
    default: str
    words: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], default: str, grams: dict[int, np.ndarray]) -> MaskFilter:
        most = max([1, *(len(g) for g in grams.values())])
        size = 1 << max(10, int(most * 12).bit_length())  # 12 or more positions for each n-gram of a language
        words = np.zeros((size, max(1, -(-len(langs) // 64))), U64)
        rate = np.zeros(len(langs))
        for i, g in grams.items():
            for at in _positions(g.astype(U64), size - 1):
                np.bitwise_or.at(words[:, i // 64], at, U64(1 << (i % 64)))
            rate[i] = np.mean((words[:, i // 64] >> U64(i % 64)) & U64(1)) ** HASHES
        return cls(langs, default, words, rate)

    def count(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Texts x languages: n-grams of each text that each language's filter has."""
        out = np.zeros((len(before) - 1, len(self.langs)))
        for w in range(self.words.shape[1]):
            found = None
            for at in _positions(h, len(self.words) - 1):
                here = self.words[:, w][at]
                found = here if found is None else found & here
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                sums = np.zeros(len(h) + 1)
                np.cumsum((found >> U64(i % 64)) & U64(1), out=sums[1:])
                out[:, i] = sums[before[1:]] - sums[before[:-1]]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of the evidence, and share of the text's n-grams that the language's filter has."""
        h, before, has = text_grams(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total = np.diff(before)[:, None]
        net = np.maximum(0.0, self.count(h, before) - total * self.false_rate) / (1 - np.minimum(self.false_rate, 0.99))
        best = net.argmax(1)
        top, all_ = net[np.arange(len(best)), best], net.sum(1)
        score = np.where(all_ > 0, top / np.where(all_ > 0, all_, 1), 0.0)
        hit = np.minimum(1.0, top / np.maximum(total[:, 0], 1))
        langs = [("und" if not ok else self.langs[i] if t > 0 else self.default) for i, t, ok in zip(best, top, has)]
        return langs, np.where(has, np.clip(score, 0, 1), 0.0), np.where(has, hit, 0.0)


def _gram_counts(batches):
    for batch in batches:
        data, off = text_view(batch.column("text"))
        lang = np.asarray(batch.column("lang_no"))
        raw = data.tobytes()
        for lo, hi, _, _ in text_slices(data, off, 1 << 20):
            h, before, _ = text_grams([raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i in range(lo, hi)])
            of = np.repeat(lang[lo:hi], np.diff(before))
            for i in np.unique(of):
                g, n = np.unique(h[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang_no", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE) -> MaskFilter:
    """Learn filters from the rows of docs with a text and a language.

    A hashed sample of about ``docs_per_language`` whole texts of each language is counted. A language's filter gets the
    n-grams that are frequent in it (three occurrences at least) and not five times as frequent in another language: of
    these the ``grams_per_language`` most frequent (of equal counts at the bound a hashed share), however large docs is.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not seen:
        return MaskFilter([], "und", np.zeros((1, 1), U64), np.zeros(0))
    langs = sorted(r.lang for r in seen)
    number = {k: i for i, k in enumerate(langs)}
    plan = d.sparkSession.createDataFrame([(r.lang, number[r.lang], int(2**31 * min(1.0, docs_per_language / r["count"]))) for r in seen], "lang string, lang_no int, share long")
    plan = F.broadcast(plan) if len(seen) <= BROADCAST_ROWS else plan
    drawn = F.abs(F.xxhash64(F.lit("lid"), "key") % F.lit(2**31)) <= F.col("share")
    chosen = d.join(plan, "lang").where(drawn).select("lang_no", "text")
    counts = durable(chosen.mapInArrow(_gram_counts, "lang_no int, gram long, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n")).where("n >= 3"))
    counts = counts.join(counts.groupBy("lang_no").agg(F.sum("n").alias("all")), "lang_no").withColumn("rate", F.col("n") / F.col("all"))
    counts = counts.join(counts.groupBy("gram").agg(F.max("rate").alias("top")), "gram").where(F.col("rate") * 5 >= F.col("top"))
    counts = durable(counts.select("lang_no", "gram", "n"))
    # one row for each language and count, not for each n-gram
    ladder = counts.groupBy("lang_no", "n").agg(F.count(F.lit(1)).alias("grams"))
    above = F.sum("grams").over(Window.partitionBy("lang_no").orderBy(F.desc("n")))
    ladder = ladder.withColumn("room", F.lit(grams_per_language) - above + F.col("grams")).where("room > 0")
    enough = (F.col("room") >= F.col("grams")) | (F.pmod(F.xxhash64("gram"), F.col("grams")) < F.col("room"))
    kept = counts.join(ladder, ["lang_no", "n"]).where(enough).select("lang_no", "gram").toPandas()
    return MaskFilter.build(langs, seen[0].lang, {int(i): np.sort(g.to_numpy()) for i, g in kept.groupby("lang_no").gram})


PREDICTION = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("hit_rate", DoubleType())])


def predictor(spark: SparkSession, model: MaskFilter):
    """A vectorised column function: text -> struct(lang, score, hit_rate). The model's size has a bound (see fit)."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows, lo, out = texts.where(texts.notna(), None).tolist(), 0, []
        while lo < len(rows):
            hi, size = lo, 0
            while hi < len(rows) and (hi == lo or size < 1 << 20):
                size, hi = size + len(rows[hi] or ""), hi + 1
            out.append(shared.value.predict(rows[lo:hi]))
            lo = hi
        tidy()
        return pd.DataFrame({"lang": [x for o in out for x in o[0]], "score": np.concatenate([o[1] for o in out] or [np.zeros(0)]), "hit_rate": np.concatenate([o[2] for o in out] or [np.zeros(0)])})

    return F.pandas_udf(run, PREDICTION).asNondeterministic()  # else the optimiser may run it twice


def identify(docs: DataFrame, model: MaskFilter, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column ``out``: lang (``und`` for a null text or one without letters), score, hit_rate."""
    return docs.withColumn(out, predictor(docs.sparkSession, model)(F.col(text).cast("string")))


def keep_identified(docs: DataFrame, model: MaskFilter, text: str = "text", min_hit_rate: float = MIN_HIT_RATE) -> DataFrame:
    """Rows of docs whose language is known; goes: ``und``, and texts that share hardly any n-gram with a language. Without
    a learnt language no row stays. All columns are kept, whatever their names."""
    name = free_name(docs, "__language")
    d = identify(docs, model, text, name)
    return d.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.hit_rate") >= min_hit_rate)).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of(F.col("doc_id")) == 0
    model = fit(d.where(~held))
    d = identify(d.select("doc_id", held.alias("held_out"), "text"), model)
    return d.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.hit_rate").alias("hit_rate"))
