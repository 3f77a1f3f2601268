"""Quality rules with an isolation forest on rule statistics.

Random splits isolate unusual documents after short paths. The forest is grown on a bounded hashed sample of the
documents that pass the fixed rules, which each tree draws its few rows from; the score above which a document is rejected is calibrated
from all labelled rows of both classes.

Defined results: a null or empty text has no words and fails the fixed rules; repeated rows get equal verdicts; equal
scores get equal verdicts (a score at the threshold is rejected); an empty table gives no rows; without labels of both
classes only the fixed rules reject. Columns of docs may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bounded_sample, durable, free_name, is_space, mix64, read, row_of, span_hashes, text_slices, text_view, tidy, word_spans

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_distinct"]
STATS_TYPE = ", ".join(f"{s}: bigint" for s in STATS)
#: Small samples keep a cluster of bad documents from hiding itself.
TREES, TREE_ROWS = 100, 64
#: Bound of the sample that the trees draw from, in documents.
FOREST_ROWS = 4 * TREES * TREE_ROWS
#: The threshold maximises the share of bad rows caught less GOOD_WEIGHT times the share of good rows lost, of which
#: GOOD_LOST at most.
GOOD_LOST = 0.02
GOOD_WEIGHT = 5.0


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def rule_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text, as arrays of counts.

    n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words inside three-word windows that
    the text has twice or more. n_marks: ASCII punctuation. n_distinct: different words.
    """
    n = len(off) - 1
    if not len(data):
        return {s: np.zeros(n, np.int64) for s in STATS}
    blank = is_space(data)
    letter = ~blank
    starts, ends, before = word_spans(data, off)
    word = span_hashes(data, starts, ends)
    doc = row_of(before)
    tag = mix64(np.arange(n, dtype=U64) + U64(77))
    # lines: cut at \n and at the ends of texts
    breaks = data == 10
    a = np.union1d(off[:-1], np.flatnonzero(breaks) + 1)
    a = a[a < len(data)]
    b = np.append(a[1:], len(data))
    b = b - ((b > a) & breaks[np.maximum(b - 1, 0)])
    filled = np.concatenate([[0], np.cumsum(letter)])
    full = filled[b] > filled[a]
    a, b = a[full], b[full]
    line_doc = np.searchsorted(off, a, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    apart = np.unique(span_hashes(data, a, b) ^ tag[line_doc], return_index=True)[1]
    dup_lines = lines - np.bincount(line_doc[apart], minlength=n)
    # words in windows of three that occur again
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = mix64(mix64(word[inside] * U64(3) + word[inside + 1]) * U64(5) + word[inside + 2]) ^ tag[doc[inside]]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[1:] = same
        again[:-1] |= same
        at = inside[order[again]]
        for j in range(3):
            covered[at + j] = True
    first = np.unique(word ^ tag[doc], return_index=True)[1] if len(word) else np.zeros(0, np.int64)
    marks = ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))
    return {
        "n_words": np.diff(before),
        "word_chars": _per_row(letter & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_row(SYMBOLS[data], off),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(doc, covered, n).astype(np.int64),
        "n_marks": _per_row(marks, off),
        "n_distinct": np.bincount(doc[first], minlength=n),
    }


def stats_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """rule_stats of an Arrow string array."""
    data, off = text_view(texts)
    parts = [rule_stats(p, o) for _, _, p, o in text_slices(data, off)]
    return {s: np.concatenate([p[s] for p in parts] or [np.zeros(0)]).astype(np.int64) for s in STATS}


def stats_column():
    """A column function: text -> struct of STATS."""

    def run(texts: pa.Array) -> pa.Array:
        out = pa.StructArray.from_arrays([pa.array(a) for a in stats_of(texts).values()], STATS)
        tidy()
        return out

    return F.arrow_udf(run, f"struct<{STATS_TYPE}>").asNondeterministic()


def base_failed(s):
    """The fixed rules: fewer than 50 words, or over half of the words in repeated windows."""
    return (s("n_words") < 50) | (100 * s("n_repeat_words") > 50 * s("n_words"))


def features(f) -> np.ndarray:
    """Characters a word, symbols a word, marks a character, and the share of different words on a logarithmic scale of
    the length (repeats come with length by nature). Repeated lines and windows are the fixed rules' matter."""
    w, c = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    cols = [f["word_chars"] / w, f["n_symbols"] / w, f["n_marks"] / c, f["n_distinct"] / w * np.log2(w + 1)]
    return np.stack([np.asarray(x, np.float64) for x in cols], 1)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), cut, left child (right is next), path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = np.inf

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of a search that fails among n rows."""
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
        r = np.random.default_rng(seed)
        rows = min(rows, len(x))
        deep = int(np.ceil(np.log2(max(rows, 2))))
        every = []
        for _ in range(trees):
            nodes = [[-1, 0.0, 0, 0.0]]
            todo = [(0, x[r.choice(len(x), rows, replace=False)], 0)]
            while todo:
                at, part, depth = todo.pop()
                spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
                if depth >= deep or not len(spread):
                    nodes[at][3] = depth + cls.expected(len(part))
                    continue
                f = int(r.choice(spread))
                cut = r.uniform(part[:, f].min(), part[:, f].max())
                nodes[at][:3] = f, cut, len(nodes)
                low = part[:, f] < cut
                todo += [(len(nodes), part[low], depth + 1), (len(nodes) + 1, part[~low], depth + 1)]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            every.append(nodes)
        size = max(map(len, every))
        grid = np.array([n + [[-1, 0.0, 0, 0.0]] * (size - len(n)) for n in every])
        return cls(grid[:, :, 0].astype(np.int64), grid[:, :, 1], grid[:, :, 2].astype(np.int64), grid[:, :, 3], max(cls.expected(rows), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, left, length in zip(self.feature, self.cut, self.left, self.length):
            at = np.zeros(len(x), np.int64)
            live = row
            while len(live):
                here = at[live]
                f = feature[here]
                live, here, f = live[f >= 0], here[f >= 0], f[f >= 0]
                at[live] = left[here] + (x[live, f] >= cut[here])
            total += length[at]
        return 2.0 ** (-(total / len(self.feature)) / self.norm)


def calibrate(score: np.ndarray, good: np.ndarray, good_lost: float = GOOD_LOST, weight: float = GOOD_WEIGHT) -> float:
    """The threshold between two neighbouring scores with the best balance of both classes (of equal ones, that in the
    widest gap). Nothing is rejected unless there are rows of both classes."""
    if good.all() or not good.any():
        return np.inf
    each = np.unique(score)
    cuts = np.append((each[1:] + each[:-1]) / 2, np.inf)
    gap = np.append(np.diff(each), 0.0)
    ok, bad = np.sort(score[good]), np.sort(score[~good])
    lost = 1 - np.searchsorted(ok, cuts) / len(ok)
    caught = 1 - np.searchsorted(bad, cuts) / len(bad)
    value = np.where(lost <= good_lost, caught - weight * lost, -np.inf)
    return float(cuts[np.lexsort((-gap, -value.round(9)))[0]])


def best_cut(scored: DataFrame, good_lost: float = GOOD_LOST, weight: float = GOOD_WEIGHT) -> float:
    """calibrate() over a table of any size: score, y (1: good). Scores are dealt by ranges; the driver gets the sums of each range
    and the best cut."""
    good = (F.col("y") == 1).cast("long")
    each = scored.groupBy("score").agg(F.sum(good).alias("ok"), F.sum(1 - good).alias("bad"))
    each = durable(each.repartitionByRange(F.col("score")).withColumn("part", F.spark_partition_id()))
    ends = each.groupBy("part").agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad"), F.min("score").alias("low")).orderBy("part").collect()  # a row a range
    n_ok, n_bad = sum(e.ok for e in ends), sum(e.bad for e in ends)
    if not n_ok or not n_bad:
        return np.inf
    rows, ok, bad = [], 0, 0
    for e, after in zip(ends, [*ends[1:], None]):
        rows.append((e.part, ok, bad, after.low if after else None))
        ok, bad = ok + e.ok, bad + e.bad
    before = scored.sparkSession.createDataFrame(rows, "part int, ok_before long, bad_before long, after double")
    w = Window.partitionBy("part").orderBy("score")
    cut = each.join(F.broadcast(before), "part").withColumn("next", F.coalesce(F.lead("score").over(w), "after")).withColumn("cut", (F.col("score") + F.col("next")) / 2)
    below = lambda c: F.col(f"{c}_before") + F.sum(c).over(w) - F.when(F.col("cut") <= F.col("score"), F.col(c)).otherwise(0)
    cut = cut.select("cut", (F.col("next") - F.col("score")).alias("gap"), (1 - below("ok") / n_ok).alias("lost"), (1 - below("bad") / n_bad).alias("caught")).where("cut is not null")
    cut = cut.where(F.col("lost") <= good_lost).withColumn("value", F.round(F.col("caught") - weight * F.col("lost"), 9))
    best = cut.orderBy(F.desc("value"), F.desc("gap"), "cut").first()
    return best.cut if best and (best.value, best.gap) > (0.0, 0.0) else np.inf  # rejecting nothing has the value 0


def _scores(shared):
    def run(batches):
        for b in batches:
            x = features({s: np.asarray(b.column(s)) for s in STATS})
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(x)), b.column("y")], names=["score", "y"])
            tidy()

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Forest:
    """Forest, of rows from a bounded hashed sample of documents, and threshold, from all labelled ones. A labelled id counts once (its largest label, and
    of several texts with that id the one with the smallest statistics)."""
    stats = lambda d: d.select("key", stats_column()(F.col("text")).alias("s")).select("key", "s.*").where(~base_failed(F.col))
    d = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    ids = d.select("key").distinct()
    share = bounded_sample(ids, "key", FOREST_ROWS, ids.count(), "forest")
    once = lambda s: s.groupBy("key").agg(F.min(F.struct(*STATS)).alias("s"), *([F.max("y").alias("y")] if "y" in s.columns else [])).select("s.*", *(["y"] if "y" in s.columns else []))
    sample = once(stats(d.join(F.broadcast(share), "key", "left_semi"))).toPandas().sort_values(STATS)
    forest = Forest.grow(features(sample) if len(sample) else np.zeros((1, 4)))
    y = labels.select(F.col(doc_id).alias("key"), F.col(quality).cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    rows = once(stats(d).join(y, "key"))  # texts stay where they are, their statistics meet the labels
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    forest.threshold = best_cut(rows.mapInArrow(_scores(shared), "score double, y int"))
    return forest


def verdict_column(spark: SparkSession, forest: Forest):
    """A column function: text -> struct of STATS, base_failed, anomaly, kept. One Python step does it all."""
    shared = spark.sparkContext.broadcast(forest)  # TREES * 2 * TREE_ROWS nodes at most

    def run(texts: pa.Array) -> pa.Array:
        s = stats_of(texts)
        failed = base_failed(s.__getitem__)
        anomaly = shared.value.score(features(s)) if len(texts) else np.zeros(0)
        kept = ~failed & (anomaly < shared.value.threshold)
        out = pa.StructArray.from_arrays([pa.array(a) for a in (*s.values(), failed, anomaly, kept)], [*STATS, "base_failed", "anomaly", "kept"])
        tidy()
        return out

    return F.arrow_udf(run, f"struct<{STATS_TYPE}, base_failed: boolean, anomaly: double, kept: boolean>").asNondeterministic()


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, STATS, base_failed, anomaly, kept. A null text has no words; so it fails."""
    verdict = verdict_column(docs.sparkSession, fit(docs, labels, doc_id, text))
    return docs.select(F.col(doc_id).alias("doc_id"), verdict(F.col(text).cast("string")).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs that pass the fixed rules and the forest, with all their columns; no others (see judge)."""
    verdict, name = verdict_column(docs.sparkSession, fit(docs, labels, doc_id, text)), free_name(docs, "__verdict")
    return docs.withColumn(name, verdict(F.col(text).cast("string"))).where(F.col(f"{name}.kept")).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
