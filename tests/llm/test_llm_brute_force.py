"""The operators that SQL can't express, against plain Python on small tables; held-out rates; empty and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import ann, bpe, langid, lm, mixing, near_dups, quality_cnn, quality_rules, queries

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def distance(a, b, most):
    """Edit distance by rows, or more than ``most``."""
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        if min(q) > most:
            return most + 1
        p = q
    return p[-1]


def brute_groups(rows):
    """Smallest id of each row's group, from all pairs of different texts."""
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple(words(t)), []).append(i)
    each = list(texts)
    root = list(range(len(each)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [set(w) for w in each]
    for i, a in enumerate(each):
        for j in range(i):
            b = each[j]
            size = max(len(a), len(b))
            most = int(0.2 * size + 1e-9)
            if find(i) != find(j) and abs(len(a) - len(b)) <= most and len(bags[i] ^ bags[j]) <= 2 * most and distance(a, b, most) <= most:
                root[find(i)] = find(j)
    first = {}
    for k, w in enumerate(each):
        first[find(k)] = min([first.get(find(k), math.inf), *texts[w]])
    return {i: first[find(k)] for k, w in enumerate(each) for i in texts[w]}


def test_near_dups_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.cluster_id for r in near_dups.cluster(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def similar_pairs(texts, least=0.8):
    """Indices of all pairs of word lists of similarity ``least`` or more: texts meet on the rarest quarter of their words
    (a pair's edits leave one of these), and are aligned where enough words are common."""
    labelled = []
    for w in texts:
        seen = Counter()
        bag = []
        for x in w:
            seen[x] += 1
            bag.append((x, seen[x]))
        labelled.append(bag)
    often = Counter(x for bag in labelled for x in bag)
    held, out = {}, set()
    for i, bag in enumerate(labelled):
        rare = sorted(bag, key=lambda x: (often[x], x))[: int((1 / least - 1) * len(bag) + 1e-9) + 1]
        for j in {j for x in rare for j in held.get(x, ())}:
            size = max(len(bag), len(labelled[j]))
            most = int((1 - least) * size + 1e-9)
            if abs(len(bag) - len(labelled[j])) <= most and len(set(bag) & set(labelled[j])) >= size - most and distance(texts[i], texts[j], most) <= most:
                out.add((j, i))
        for x in rare:
            held.setdefault(x, []).append(i)
    return out


def test_near_dups_against_all_pairs_of_a_larger_table(spark):
    """All pairs of different texts of sf0.1: what share of those of similarity 0.8 or more lies in one group."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    rows = {}
    for r in docs.collect():
        rows.setdefault(tuple(words(r.text)), r.doc_id)
    texts = [w for w in rows if w]
    pairs = similar_pairs(texts)
    got = {r.doc_id: r.cluster_id for r in near_dups.cluster(docs).collect()}
    lost = [(rows[texts[a]], rows[texts[b]]) for a, b in pairs if got[rows[texts[a]]] != got[rows[texts[b]]]]
    print(len(pairs), "pairs, lost:", lost)
    assert len(pairs) > 1000 and not lost


def test_pipeline_against_plain_python(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    grams = [set(g[a:b].tolist()) for g, before, _ in [langid.text_grams([r.text for r in rows])] for a, b in zip(before, before[1:])]
    langs, _, hit = model.predict([r.text for r in rows])
    rows = [r for r, lang, h, g in zip(rows, langs, hit, grams) if lang != "und" and h >= langid.MIN_HIT_RATE and g]
    assert all(any(c.isalpha() for c in r.text) for r in rows)
    forest = quality_rules.fit(spark.createDataFrame(rows, docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet"))

    def good(text):
        w = WORD.findall(text)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)} if len(set(three)) < len(three) else ()
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            return False
        chars, marks = sum(map(len, w)), sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
        x = [chars / len(w), sum(c in "#*$%&|<>" for c in text) / len(w), marks / chars, len(set(w)) / len(w) * math.log2(len(w) + 1)]
        total = 0.0
        for feature, cut, left, length in zip(forest.feature, forest.cut, forest.left, forest.length):
            at = 0
            while feature[at] >= 0:
                at = left[at] + (x[feature[at]] >= cut[at])
            total += length[at]
        return 2 ** (-total / len(forest.feature) / forest.norm) < forest.threshold

    rows = [r for r in rows if good(r.text)]
    group = brute_groups([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if 2 * size[s] <= weight[s] * level}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        left, rest = left - sum(2 * size[s] for s in full), rest - full
    target |= {s: weight[s] * level for s in rest}
    want = []
    for r in rows:
        rate = target[r.source] / size[r.source]
        draw = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        ids = library.encode(r.text, add_special_tokens=False).ids
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want += [(r.doc_id, r.source, len(ids), *digests)] * (int(rate) + (draw < rate - int(rate)))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and want


def test_held_out_rates(spark):
    """Rows that training never saw: accuracy against always answering the commoner label, and both kinds of errors."""
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = queries.QUERIES["op5_quality_cnn"](spark, LARGE).join(labels, "doc_id").where("held_out").toPandas()
    base = max(got.quality.mean(), 1 - got.quality.mean())
    assert base < 0.88 and (got.predicted == got.quality).mean() > base + 0.08
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    q = quality_rules.judge(docs, labels.where(~held)).join(labels.where(held), "doc_id").where("not base_failed").toPandas()
    bad = q.quality == 0
    assert bad.sum() > 30 and (~q[bad].kept).mean() > 0.9 and q[~bad].kept.mean() > 0.98


def test_language_brute_force(spark):
    """Filters against exact sets of n-grams, with more languages than a word has bits."""
    r = np.random.default_rng(3)
    grams = {i: np.unique(r.integers(-(2**62), 2**62, 300)) for i in range(70)}
    model = langid.MaskFilter.build([f"l{i:02d}" for i in range(70)], "l00", grams)
    probe = np.concatenate([g[:50] for g in grams.values()]).astype(np.uint64)
    exact = np.array([[len(np.intersect1d(grams[i], grams[j][:50])) for i in range(70)] for j in range(70)])
    found = model.count(probe, np.arange(71) * 50)
    assert (found >= exact).all() and (found - exact).mean() < 1 and (found.argmax(1) == np.arange(70)).all()
    assert langid.text_grams([chr(0x30001) * 5, "\u00e9", "12", None])[2].tolist() == [True, True, False, False]


def test_repeats_are_told_apart(spark):
    """Held-out texts that training has, among others of the same words."""
    r = np.random.default_rng(1)
    text = [" ".join(f"w{k}" for k in r.zipf(1.3, 120) % 800) for _ in range(300)]
    rows = [(i, t, False) for i, t in enumerate(text[:250])] + [(1000 + i, t, True) for i, t in enumerate(text[200:300])]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), F.col("h")).where("held_out").toPandas()
    per = (got.score / got.n_tokens).to_numpy()
    twin = (got.doc_id < 1050).to_numpy()
    assert twin.sum() == 50 and per[twin].min() > per[~twin].max()


def test_ann_has_enough_candidates(spark):
    """One cell a query, most of which hold a few rows: further cells are visited until there are k rows."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)) * np.repeat([0.1, 5.0], [270, 30])[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, lambda c: c % 10 == 0, probes=1).groupBy("query_id").count().collect()
    assert len(got) == 30 and {g["count"] for g in got} == {20}
    few = ann.search(df.where("vec_id < 8"), lambda c: c % 2 == 0).groupBy("query_id").count().collect()
    assert {g["count"] for g in few} == {7}


def test_salted_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", None if i % 3 == 0 else f"s{i % 2}", {"k": i}) for i in range(60)], "doc_id long, text string, source string, extra map<string, int>")
    small = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == small
    assert mixing.emit_copies(docs).columns == docs.columns


def test_stages_on_odd_tables(spark):
    """Nulls in each column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, language string, s string, __verdict int, __near_name int, __mix_rate int, key int"
    more = ("x", "y", 1, 2, 3, 4)
    text = "the cat sat on the mat and then it ran off to see what was in the old barn by the long river " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + "now", "en", None, 2), (None, None, None, None, None), (3, "", "en", "b", 0), (-4, "x" * 60000 + " y", "de", "b", 4), (-4, text.upper(), None, "a", 5), (8, " ".join(f"w{i}" for i in range(500)), "en", "c", 6)]
    docs = spark.createDataFrame([(*r, *more) for r in rows], schema)
    for table in (docs, docs.limit(0)):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SMALL)
            count = out.count()
            if name != "bpe":
                assert out.columns == d.columns, name
            assert count <= 2 * d.count(), name
            stage(spark, table, SMALL).count()
    assert near_dups.drop_near_duplicates(docs).count() == 4
    assert quality_cnn.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is not None


def test_bpe_on_every_code_point():
    """Ids and decoded text as the library has them, for every code point beside letters, digits, symbols and itself, and
    for random texts of such."""
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    merges = bpe.Merges(path)
    encoder, decoder = bpe.Encoder(merges), bpe.Decoder(merges)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rnd = random.Random(4)
    texts = [f"a{c}b {c}1{c}{c} {c}!{c}Z" for c in points]
    texts += ["".join(rnd.choice(points) if rnd.random() < 0.5 else rnd.choice("ab1 .'-s") for _ in range(rnd.randrange(1, 30))) for _ in range(20_000)]
    for lo in range(0, len(texts), 8192):
        part = texts[lo : lo + 8192]
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        for text, ids in zip(part, want):
            assert encoder.encode(text) == ids, ascii(text)
        decoded = library.decode_batch(want, skip_special_tokens=False)
        for ids, text in zip(want, decoded):
            assert decoder.push(ids) + decoder.finish() == text


def test_ann_searches_each_length_among_its_like(spark):
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=4 if i % 7 else 3).tolist(), 0.5, i) for i in range(1, 400)] + [(500, [], 0.5, 1), (501, [0.0] * 3, 0.5, 1), (None, [1.0] * 3, 0.5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, cell int")
    got = {}
    for r in ann.search(df, lambda c: c % 5 == 0, k=6, probes=1000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    like = {i: np.array(v) for i, v, *_ in rows if i is not None and np.any(v)}
    for q, v in like.items():
        if q % 5 == 0:
            near = sorted((-(v * o).sum(), i) for i, o in like.items() if i != q and len(o) == len(v))[:6]
            assert sorted(got.pop(q)) == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert not got
