"""Whitening, spelling variants and packing against plain Python and numpy; odd tables."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import packing, queries, spelling, whitening

DATA, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_whitening(vectors, most=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(0)
    d = x - s / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), d @ u / np.sqrt(e), e / np.trace(v), e


def check_whitening(got, ids, vectors, most=32):
    n, deviation, white, share, e = brute_whitening(vectors, most)
    got = got.sort_values(["vec_id", "component"])
    k = white.shape[1]
    assert len(got) == len(ids) * k and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-6
    order = np.argsort(ids, kind="stable")
    assert (got.deviation.to_numpy().reshape(-1, k) == deviation[order][:, None]).all()
    mine, want = got.whitened.to_numpy().reshape(-1, k), white[order]
    apart = np.abs(np.diff(np.append(e, 0))) > 1e-9 * e[0]
    sign = np.sign((mine * want).sum(0))
    assert np.allclose((mine * sign)[:, apart], want[:, apart], atol=1e-6)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k)[0], share, rtol=1e-9)


def test_whitening(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitening(queries.QUERIES["op11_whitening"](spark, DATA).toPandas(), np.array([r.vec_id for r in rows]), [r.embedding for r in rows])


def test_whitening_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 3)).tolist()
    rows = [(i, v, "x", 1) for i, v in enumerate(base)] + [(100 + i, base[0], "x", 1) for i in range(60)]  # a hot vector
    bad = [(200, None, None, 1), (201, [1.0, None, 2.0], "x", None), (202, [1.0, float("nan"), 2.0], "x", 1), (203, [1.0, float("inf"), 2.0], "x", 1)]
    schema = "vec_id long, embedding array<double>, component string, x int"
    got = whitening.whiten(spark.createDataFrame(rows + bad, schema)).toPandas()
    check_whitening(got, np.array([r[0] for r in rows]), [r[1] for r in rows])
    # lengths apart; an empty vector has no component; zero vectors take part; a null id stays
    mixed = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (None, [2.0, 1.0]), (4, []), (5, [1.0, 2.0, 3.0]), (6, [3.0, 2.0, 9.0])]
    got = whitening.whiten(spark.createDataFrame(mixed, "vec_id long, embedding array<float>")).toPandas()
    assert sorted(got.n.unique()) == [2, 4] and len(got) == 4 * 2 + 2 * 3 and got.vec_id.isna().sum() == 2
    flat = got[(got.n == 2) & (got.component > 1)]
    assert flat.whitened.isna().all() and (flat.explained < 1e-9).all() and got.identity_error.max() < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")).toPandas()
    assert same.whitened.isna().all() and same.explained.isna().all() and (same.deviation == 0).all()
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).toPandas()
    assert huge.deviation.isna().all() and np.allclose(np.abs(huge.whitened), 1)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    once = whitening.whiten(spark.createDataFrame(rows, schema), by="one").toPandas()
    n, _, _, share, _ = brute_whitening(base)
    assert (once.n == n).all() and np.allclose(sorted(once.explained.unique(), reverse=True), share)


def brute_spelling(docs):
    count = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 3}
    gaps = defaultdict(set)  # a word with a gap at a place: what differs there, or is missing
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for (a, b), ws in gaps.items():
        ws = ws | ({a + b} & n.keys())
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def spelled(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_brute_near_words():
    """The brute force's own rule, on all pairs of a small vocabulary."""
    docs = [(None, " ".join([w] * 3)) for w in ("aabbc", "aabbcc", "abbcc", "aabbd", "babbc", "aabbcd", "zabbc")]
    near = {w: v[1] for w, v in brute_spelling(docs).items()}
    one = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b))))
    assert near == {a: sum(one(a, b) for b in near) for a in near}


def test_spelling(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()]
    got = queries.QUERIES["op12_spelling"](spark, LARGE)
    assert got.count() == len(spelled(got))
    want = brute_spelling(docs)
    assert spelled(got) == want and any(v[2] for v in want.values()) and any(v[4] != w and v[4] != v[2] for w, v in want.items())


def test_spelling_odd_texts_and_rounds(spark, monkeypatch):
    long = "Abé" * 2000
    docs = [(1, f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} {long[:-1]}" + f" {long[:-1]}" * 5), (2, None), (3, ""), (None, "×÷Àabc ×÷Àabc " * 4 + "STRASSE straße strase " * 5), (4, "Strasse strase " * 9), (4, "Strasse strase " * 9), (5, "œuvre一words words Words wordz wordz wordz sword sword sword")]
    d = spark.createDataFrame([(*r, "n", 1) for r in docs], "doc_id long, text string, near string, word int").repartition(3)
    want = brute_spelling(docs)
    assert spelled(spelling.variants(d)) == want and len(want) > 6
    assert spelling.variants(d.limit(0)).count() == 0
    monkeypatch.setattr(spelling, "COUNTED", 2)
    monkeypatch.setattr(spelling, "FOUND_BYTES", 8)
    made = spelling.rounds
    monkeypatch.setattr(spelling, "rounds", lambda lengths: made(lengths, 192))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    few = spelling.vocabulary(docs)
    sizes = {r.size: r["count"] for r in few.groupBy(F.length("word").alias("size")).count().collect()}
    assert len(spelling.rounds(sizes)) > 2 and any(k > 1 for r in spelling.rounds(sizes) for _, _, k in r)
    assert spelled(spelling.variants(docs)) == brute_spelling([(r.doc_id, r.text) for r in docs.collect()])


def test_filters_lose_nothing():
    rng = np.random.default_rng(5)
    codes = rng.integers(97, 123, (20_000, 7), dtype=np.uint8)
    h = spelling.plain_hash(codes)
    f = spelling.Filter(len(h))
    f.add(h)
    assert len(f.has(h)) == len(h)
    assert len(f.has(spelling.plain_hash(rng.integers(97, 123, (200_000, 8), dtype=np.uint8)))) < 2_000
    # hashes of edits are those of the strings
    for row, at, letter, eh in spelling.edits(codes[:50], np.arange(97, 123, dtype=np.uint8), True, True):
        for r, p, c, e in zip(row, at, letter, eh):
            w = codes[r].tobytes()
            s = w[:p] + (bytes([c]) if c >= 0 else b"") + w[p + 1 :]
            assert spelling.plain_hash(np.frombuffer(s, np.uint8)[None])[0] == e


def library():
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def check_packing(got, docs, t):
    """docs: (doc_id, text) rows. Pieces as plain Python makes them; sequences gapless and not too long; their number."""
    want = Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [*range(len(ids), 0, -2048), 0][::-1]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    return len(bins), -(-sum(r.length for r in got) // 2048)


def test_packing(spark):
    t, *_ = library()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.QUERIES["op13_packing"](spark, DATA)
    bins, least = check_packing(got.collect(), docs, t)
    assert bins <= least + 1


def test_packing_odd_texts(spark):
    t, path, ranks = library()
    docs = [(1, None), (2, ""), (None, "a null id"), (4, "twice"), (4, "twice"), (5, "x" * 70_000), (6, " " * 5000 + "\n\t " * 999), (7, "<|endoftext|> inside <|endoftext|>"), (8, "՘Ᲊ 一二 ١٢ é"), (9, "word " * 2047), (10, "word " * 4095), (11, "one " * 700_000)]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in docs], "doc_id long, text string, part string, length int, nth int").repartition(4)
    for r in (None, ranks):
        got = packing.pack(df, path, r).collect()
        bins, least = check_packing(got, docs, t)
        assert bins <= least + 1
    assert packing.pack(df.limit(0), path).count() == 0


def test_tokens_on_every_code_point():
    t, path, ranks = library()
    mine = packing.Tokens(path, ranks)
    for lo in range(0, 0x110000, 256):
        block = [chr(c) for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}1{c}{c} {c}!{c}" for c in block]
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in mine.encode(texts)] == want, hex(lo)
    assert mine.same("plain é一") and not mine.same("՘")


def test_fullest_combination():
    rng = np.random.default_rng(8)
    for _ in range(200):
        room, items = int(rng.integers(1, 40)), rng.integers(1, 30, int(rng.integers(0, 9)))
        reach = {0}
        for n in items:
            reach |= {r + int(n) for r in reach if r + n <= room}
        got = packing.fullest(np.bincount(items, minlength=41), room, 40)
        assert sum(n * k for n, k in got) == max(reach) and all(k <= (items == n).sum() for n, k in got)
    for lengths in (rng.integers(1, 2049, 5000), np.full(3000, 700), rng.integers(1000, 1100, 2000)):
        counts = np.bincount(lengths, minlength=2049)
        rows = packing.plan(counts)
        room = Counter()
        for n, low, high, per, first, offset in rows:
            for b in range((high - low) // per):
                room[first + b] += n * per
        for n in range(1, 2049):  # every piece once
            spans = sorted((low, high) for m, low, high, *_ in rows if m == n)
            assert [a for a, _ in spans] == [0, *[b for _, b in spans]][:-1] if counts[n] else not spans
            assert not spans or spans[-1][1] == counts[n]
        assert max(room.values()) <= 2048
        high = np.sort(lengths)[::-1]
        bins = []  # first fit on falling lengths
        for n in high.tolist():
            k = next((k for k, r in enumerate(bins) if r >= n), None)
            if k is None:
                bins.append(2048 - n)
            else:
                bins[k] -= n
        assert len(room) <= len(bins)
