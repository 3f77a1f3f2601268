"""Language-model scoring of whole texts with a sharded Elias-Fano trigram trie.

P(w | g h) = (c(g h w) + k(h) c(h w) + NU P(w)) / (c(g h) + k(h) c(h) + NU): triples, and pairs and words as pseudo-counts,
with P(w) = (c(w) + 0.5) / Z, Z = N + 0.5 (V + 1), and k(h) = TAU / max(c(h), N / COMMON), so that all pairs of a context
weigh TAU at most. The sum over all words is 1. In logarithms a text's score is the sum over its tokens of log P(w), of
log NU, of the gain log(1 + (c(g h w) + k(h) c(h w)) / (NU P(w))), and less log(c(g h) + k(h) c(h) + NU) for each context.
The gain is found where w is, a context's weight where h is: each needs one lookup only, so the model is dealt out by
word over shards of bounded size and never leaves its shard. Where c(h) isn't at hand, k(h) is: words of N / COMMON or more
tokens are COMMON at most, and their counts go to every task.

Tokens are keyed by 64-bit hashes, contexts by 32 bits of them. Texts travel as packed token lists (one row for each
slice of texts and shard), so a hot word costs a slice one entry; very frequent words are dealt over several shards by
their context. A pair stays in one shard.

Defined results: a null or empty text has its end only; repeated rows count and are scored each; without training rows N
and V are 0 and every base score is that of a uniform choice; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, durable, fold_of, mix64, read, span_hashes, text_slices, text_view, tidy, word_spans
from .ngram_trie import Trie

TAU, NU = 4.0, 0.5
COMMON = 10_000
#: Text bytes a shard stands for; bytes of texts in a slice; distinct words a task gathers before it sends their counts.
SHARD_BYTES = 8 << 20
SLICE = 2 << 20
GATHERED = 500_000

END, START = U64(0xE4D), U64(0x57A47)


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens (words, then one end a text), and the tokens before each text."""
    starts, ends, before = word_spans(data, off)
    n = len(off) - 1
    before = before + np.arange(n + 1)
    out = np.empty(before[-1], U64)
    out[before[1:] - 1] = END
    at = np.ones(len(out), bool)
    at[before[1:] - 1] = False
    out[at] = span_hashes(data, starts, ends, fold_case=True)
    return out, before


def _slices(batches, columns):
    for b in batches:
        data, off = text_view(b.column("text"))
        for lo, hi, part, o in text_slices(data, off, SLICE):
            yield part, o, [b.column(c).slice(lo, hi - lo) for c in columns]
        tidy()


def short(key: np.ndarray) -> np.ndarray:
    """A context's 32 bits."""
    return (mix64(key) >> U64(32)).astype(np.uint32)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


def count_words(train: DataFrame, shards: int) -> tuple[int, int, int, dict[int, int]]:
    """All tokens N, distinct tokens, texts, and the exact counts of the words of N / COMMON tokens or more (COMMON words
    at most)."""

    def pack(batches):
        keys, counts, held = [], [], 0

        def flush():
            key, n = _merge(keys, counts)
            shard = (key % U64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            key, n, cut = key[order], n[order], np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([a[cut[s] : cut[s + 1]].tobytes() for s in used], pa.binary()) for a in (key, n.astype(np.uint32)))], names=["shard", "keys", "counts"])

        for part, o, _ in _slices(batches, []):
            key, n = np.unique(_tokens(part, o)[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held >= GATHERED:
                key, n = _merge(keys, counts)
                keys[:], counts[:], held = [key], [n], len(key)
                if held >= GATHERED // 2:
                    yield flush()
                    keys[:], counts[:], held = [], [], 0
        if keys:
            yield flush()

    def add(t: pa.Table) -> pa.Table:
        key, n = _merge([np.frombuffer(b"".join(t.column("keys").to_pylist()), U64)], [np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint32)])
        return pa.table([[int(n.sum())], [len(key)], pa.array([key.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["total", "distinct", "keys", "counts"])

    t = durable(train.select("text").mapInArrow(pack, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(add, "total long, distinct long, keys binary, counts binary"))
    whole = t.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    total = whole.n or 0

    def frequent(batches):
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                key, n = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                take = (n * COMMON >= total) | (key == int(END))
                yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(n[take])], names=["key", "n"])

    rows = t.select("keys", "counts").mapInArrow(frequent, "key long, n long").collect()
    counts = {r.key & (2**64 - 1): r.n for r in rows}
    texts = counts.get(int(END), 0)
    return total, whole.v or 0, texts, {k: n for k, n in counts.items() if n * COMMON >= total}


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, tau: float = TAU, nu: float = NU) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``held_out`` (a condition) is false; a null text is empty and has its end only.
    Without training rows N and V are 0. Repeated rows count and are scored each. An empty table gives no rows.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(6, -(-size // shard_bytes))
    total, distinct, starts, counts = count_words(d.where(~F.col("held")), shards)
    z = total + 0.5 * (distinct + 1)
    floor = max(total / COMMON, 1e-9)
    common_keys = np.array(sorted(counts), U64)
    common_counts = np.array([counts[int(k)] for k in common_keys], np.int64)
    # contexts of known count by their 32 bits, the start of a text among them
    marks = np.append(short(common_keys), short(np.array([START], U64)))
    mark_counts = np.append(common_counts, starts)
    order = np.argsort(marks, kind="stable")
    marks, mark_counts = marks[order], mark_counts[order]
    parts = np.maximum(1, np.minimum(shards, -(-common_counts * 8 * shards // max(total, 1)))).astype(U64)  # shards of each
    weight = lambda c: tau / np.maximum(c, floor)
    first_norm = float(np.log10(starts + weight(starts) * starts + nu))

    def common_at(key: np.ndarray) -> np.ndarray:
        """Place in common_keys, or -1."""
        if not len(common_keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(common_keys, key), len(common_keys) - 1)
        return np.where(common_keys[at] == key, at, -1)

    def context_weight(context: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(marks, context), len(marks) - 1)
        return weight(np.where(marks[at] == context, mark_counts[at], 0))

    def pack(batches):
        task, k = TaskContext.get().partitionId(), 0
        for part, o, (ids, held) in _slices(batches, ["doc_id", "held"]):
            word, before = _tokens(part, o)
            n = len(o) - 1
            test = np.asarray(held).astype(bool)
            place = np.empty(n, np.int64)  # training texts first
            place[np.argsort(test, kind="stable")] = np.arange(n)
            doc = np.repeat(place, np.diff(before)).astype(np.uint32)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[before[:-1]] = START
            context = short(context)
            earlier = np.empty_like(context)  # the token before the context
            earlier[1:] = context[:-1]
            earlier[before[:-1]] = short(np.array([START], U64))[0]
            shard = word % U64(shards)
            at = common_at(word)
            if len(parts):
                shard = (shard + np.where(at >= 0, context.astype(U64) % parts[at], U64(0))) % U64(shards)
            order = np.argsort((shard << U64(44)) | (word >> U64(20)), kind="stable")
            word, shard = word[order], shard[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (shard[1:] != shard[:-1])]))
            run = np.diff(np.append(first, len(word))).astype(np.uint32)
            cut, groups = np.searchsorted(shard, np.arange(shards + 1)), np.searchsorted(shard[first], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cut))
            narrow = doc[order].astype(np.uint16) if n < 1 << 16 else doc[order]
            cells = [[a[c[s] : c[s + 1]].tobytes() for s in used] for a, c in ((word[first], groups), (run, groups), (context[order], cut), (earlier[order], cut), (narrow, cut))]
            name, m = task << 32 | k, len(used)
            k += 1
            whole = pa.array([None] * m + [ids.take(pa.array(np.argsort(place))).to_pylist()], pa.list_(pa.int64()))
            size_of = np.diff(before)[np.argsort(place)].astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*used, name % shards], pa.int32()), pa.array([name] * (m + 1), pa.int64()), pa.array([n] * (m + 1), pa.int32()), pa.array([n - int(test.sum())] * (m + 1), pa.int32())]
                + [pa.array([*c, extra], pa.binary()) for c, extra in zip(cells, (None, None, None, None, size_of))]
                + [whole],
                names=["shard", "slice", "n", "train", "words", "runs", "contexts", "earlier", "docs", "ids"],
            )

    def lookup(t: pa.Table) -> pa.Table:
        info = t.filter(pa.compute.is_valid(t.column("ids")))
        t = t.filter(pa.compute.is_null(t.column("ids")))
        names, n, train = (np.asarray(t.column(c)) for c in ("slice", "n", "train"))
        joined = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        word, run, context, earlier = joined("words", U64), joined("runs", np.uint32), joined("contexts", np.uint32), joined("earlier", np.uint32)
        doc = [np.frombuffer(r.as_buffer(), np.uint16 if k < 1 << 16 else np.uint32) for r, k in zip(t.column("docs"), n)]
        seen = np.concatenate([x < k for x, k in zip(doc, train)] or [np.zeros(0, bool)])
        # distinct words, pairs and triples of the shard with their counts in training
        key, back = np.unique(word, return_inverse=True)
        token = np.repeat(back.astype(np.uint32), run)
        count = np.bincount(token[seen], minlength=len(key))
        at = common_at(key)
        count = np.where(at >= 0, common_counts[at] if len(common_counts) else 0, count)
        pair, pair_of = np.unique((token.astype(U64) << U64(32)) | context, return_inverse=True)
        del context, token
        pair_of = pair_of.astype(np.uint32)
        triple, triple_of = np.unique((pair_of.astype(U64) << U64(32)) | earlier, return_inverse=True)
        triple_of = triple_of.astype(np.uint32)
        del earlier
        count2, count3 = np.bincount(pair_of[seen], minlength=len(pair)), np.bincount(triple_of[seen], minlength=len(triple))
        low = U64(0xFFFFFFFF)
        word2, pair3 = (pair >> U64(32)).astype(np.int64), (triple >> U64(32)).astype(np.int64)
        prior = nu * (count + 0.5) / z
        own_norm = weight(count) * count + nu
        lift2 = context_weight((pair & low).astype(np.uint32)) * count2
        # learn: what training holds goes into the trie
        known, known2, known3 = count > 0, count2 > 0, count3 > 0
        new, new2 = np.cumsum(known) - 1, np.cumsum(known2) - 1
        trie = Trie.mapped(Trie.levels(
            key[known], count[known], (new[word2[known2]], pair[known2] & low), (new2[pair3[known3]], triple[known3] & low),
            gain2=np.log10(1 + lift2[known2] / prior[word2[known2]]),
            norm2=np.log10(count2[known2] + own_norm[word2[known2]]),
            gain3=np.log10(1 + (count3[known3] + lift2[pair3[known3]]) / prior[word2[pair3[known3]]]),
        ))
        del lift2, known, known2, known3, new, new2, count2, count3
        # score: distinct words, then pairs below them, then triples below these
        rank = trie.word_rank(key)
        c = np.where(rank >= 0, trie.counts[np.maximum(rank, 0)] if len(trie.counts) else 0, 0)
        at2 = trie.pair(rank[word2], pair & low)
        norm = np.log10(own_norm)[word2]
        gain2 = np.zeros(len(pair))
        norm[at2 >= 0], gain2[at2 >= 0] = (trie.value(k, at2[at2 >= 0]) for k in ("norm2", "gain2"))
        norm[key[word2] == END] = 0.0  # nothing follows an end
        at3 = trie.triple(at2[pair3], triple & low)
        more = gain2[pair3]
        more[at3 >= 0] = trie.value("gain3", at3[at3 >= 0])
        more -= norm[pair3]
        log_c = np.log10(c + 0.5)
        out, place = [], 0
        for x in doc:  # a slice's texts that have a token here
            span = slice(place, place + len(x))
            place += len(x)
            m = int(x.max()) + 1 if len(x) else 0
            w = word2[pair_of[span]]
            sums = [np.bincount(x, v, m) for v in (log_c[w], more[triple_of[span]], c[w] > 0)]
            here = np.unique(x)
            known = sums[2][here].astype(np.uint32)
            known = known.astype(np.uint16) if not len(known) or known.max() < 1 << 16 else known
            out.append([a.tobytes() for a in (here, sums[0][here], sums[1][here].astype(np.float32), known)])
        cols = [pa.array(names, pa.int64()), *(pa.array([r[i] for r in out], pa.binary()) for i in range(4)), pa.nulls(len(names), pa.list_(pa.int64())), pa.array(n, pa.int32())]
        a = pa.table(cols, names=["slice", "docs", "log_c", "more", "known", "ids", "train"])
        k = len(info)
        b = pa.table([info.column("slice"), info.column("docs"), *([pa.nulls(k, pa.binary())] * 3), info.column("ids"), info.column("train")], names=a.column_names)
        tidy()
        return pa.concat_tables([a, b.cast(a.schema)])

    def finish(t: pa.Table) -> pa.Table:
        info = t.filter(pa.compute.is_valid(t.column("ids")))
        t = t.filter(pa.compute.is_null(t.column("ids")))
        ids, train = info.column("ids").to_pylist()[0], info.column("train").to_pylist()[0]
        size = np.frombuffer(info.column("docs").to_pylist()[0], np.int64)
        n = len(ids)
        joined = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        kind = np.uint16 if n < 1 << 16 else np.uint32
        doc = joined("docs", kind)
        add = lambda c, kind: np.bincount(doc, joined(c, kind), n)
        known = [np.frombuffer(r, np.uint16 if len(r) * np.dtype(kind).itemsize == 2 * len(x) else np.uint32) for r, x in zip(t.column("known").to_pylist(), t.column("docs").to_pylist())]
        known = np.bincount(doc, np.concatenate(known or [np.zeros(0)]), n).astype(np.int64)
        base = add("log_c", np.float64) - size * np.log10(z)
        whole = base + add("more", np.float32) + size * np.log10(nu) - first_norm
        cols = [pa.array(ids, pa.int64()), pa.array(np.arange(n) >= train), pa.array(size), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(whole)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    packed = d.mapInArrow(pack, "shard int, slice long, n int, train int, words binary, runs binary, contexts binary, earlier binary, docs binary, ids array<long>")
    found = packed.groupBy("shard").applyInArrow(lookup, "slice long, docs binary, log_c binary, more binary, known binary, ids array<long>, train int")
    return found.groupBy("slice").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) == 1)
