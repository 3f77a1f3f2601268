"""The ten operators on small tables: brute force, SQL, round trips, and the cases that must not crash."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import ann, bpe, chat, langid, lm, mixing, near_dups, ngram_trie, quality_cnn, quality_rules, queries, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
# nulls in each column, empty and long texts, repeated rows, a clashing extra column
DOCS = [(1, "the cat sat on the mat " * 20, "en", "a", 9), (1, "the cat sat on the mat " * 20, "en", "a", 9), (2, None, None, None, 1), (3, "", "en", "b", 2), (None, "ein Hund und eine Katze " * 15, "de", None, 3), (4, "x" * 70000 + " y", "de", "b", 4), (5, "12 34 !!", "en", "c", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def test_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, DATA).toPandas(), db.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        flat = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
        assert [x.replace(".0", "") for x in flat(got)] == [x.replace(".0", "") for x in flat(want)], name


def test_mixing(docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(DOCS) and (got.taken <= 2 * got["size"]).all()
    assert (got.target <= 2 * got.source_size).all()
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.emit_copies(docs)
    assert out.columns == docs.columns and out.count() == got.copies.sum()
    totals = mixing.source_targets(docs.select("source", mixing.word_count(F.col("text")).alias("size"))).toPandas()
    assert abs(totals.target.sum() - 1.5 * totals.source_size.sum()) < 1e-6


def test_language(docs, spark):
    r = langid.identify(docs.where("text is null or doc_id = 5"), langid.fit(docs)).collect()
    assert {x.language.lang for x in r} == {"und"}
    assert {x.language.lang for x in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    got = queries.QUERIES["op2_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.where("text is null or doc_id = 5").count() == 0
    model = langid.MaskFilter.build(["a", "b"], "a", {0: np.arange(500, dtype=np.int64) * 7919, 1: np.arange(250, 750, dtype=np.int64) * 7919})
    found = model.count((np.arange(750) * 7919).astype(np.uint64), np.array([0, 250, 500, 750]))
    assert found[1].tolist() == [250, 250] and found[0, 0] == 250 and found[2, 1] == 250 and found[0, 1] < 25


def test_ann_recall(spark):
    """Vectors without clusters beside a large group of near copies: against brute force."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x[1000:3500] = x[1000] + rng.normal(size=(2500, 32)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, lambda c: c % 100 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in range(0, len(x), 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(sum(score[i] >= np.sort(score)[-20] - 1e-12 for i in got[q]) / 20)
    assert len(got) == 60 and np.mean(hits) >= 0.9 and min(hits) >= 0.5


def test_ann(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 10)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[0].tolist()) for i in range(30)]
    rows += [(2000, None), (2020, [0.0] * 10), (2040, [float("nan")] * 10), (2060, [1.0]), (None, x[1].tolist()), (2080, [None] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, lambda c: c % 20 == 0).toPandas()
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 10 and None not in v and all(map(math.isfinite, v)) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = (m * m[ids == q][0]).sum(1)
        want = sorted([(-a, i) for a, i in zip(s, ids) if i != q])[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        hits, total = hits + len({i for _, i in want} & set(mine.vec_id)), total + 20
        if q == 0:  # thirty copies tie
            assert mine.vec_id.tolist() == [i for _, i in want]
    assert hits / total >= 0.9
    assert ann.search(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_bpe(docs, spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, m = Tokenizer.from_file(path), bpe.Merges(path)
    e, d, r = bpe.Encoder(m, memo=50), bpe.Decoder(m), random.Random(1)
    texts = ["", "Ünï<|endoftext|>Σας ΟΔΟΣ'S x\x1cy ٣٤ don't", "a" * 3000, "the" * 900 + "!" * 700, "日本語" * 300, "ȩ́. K ß", *["".join(r.choice("aeinrst") for _ in range(2500)) for _ in range(5)], *[t for _, t, *_ in DOCS if t]]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == want
        assert "".join(d.push(want[i : i + 3]) for i in range(0, len(want), 3)) + d.finish() == library.decode(want, skip_special_tokens=False)
    out, word = [], b"thequickbrown" * 500
    for i in range(0, len(word), 7):  # stable tokens come early, in constant memory
        out += e.feed(word[i : i + 7])
        assert len(e.window) <= e.look + 2 * e.step
    assert len(out) > 500 and out + e.finish() == library.encode(word.decode(), add_special_tokens=False).ids
    plain = bpe.Decoder(m, spaced=False)
    assert plain.push(library.encode("héllo wörld", add_special_tokens=False).ids) + plain.finish() == "héllo wörld "
    got = bpe.token_digests(docs, path).collect()
    assert len(got) == len(DOCS) and {x.ids_sha256 for x in got if x.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}


def test_quality_cnn(docs, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.QUERIES["op5_quality_cnn"](spark, DATA).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == got.quality).mean() > 0.85
    model = quality_cnn.fit(docs, labels.limit(0))
    s = docs.select(quality_cnn.scorer(spark, model)(F.col("text")).alias("s")).toPandas().s
    assert (s == 0.5).all()
    one = quality_cnn.ByteConv.fresh()
    t = [b"", b"abc", b"x" * 1000, "é".encode() * 333]
    each = [one.score(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in t]
    both = one.score(np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in t])]))
    assert np.allclose(each, both)


def test_elias_fano():
    r = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 5), (1000, 3000), (1000, 2**62)):
        v = np.sort(r.integers(0, top, n, dtype=np.int64).astype(np.uint64))
        v = np.unique(v)
        ef = ngram_trie.EliasFano.build(v)
        assert (ef.get(np.arange(len(v))) == v).all() if len(v) else True
        probe = np.unique(np.concatenate([v, r.integers(0, top, 500, dtype=np.int64).astype(np.uint64)]))
        want = {int(x): i for i, x in enumerate(v)}
        assert ef.find(probe).tolist() == [want.get(int(x), -1) for x in probe]


def test_lm(docs, spark):
    held = F.col("doc_id") % 3 == 0
    got = lm.score(docs, held, shard_bytes=20000).toPandas()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seq = [(i, i is not None and i % 3 == 0, [*WORD.findall((t or "").translate(low)), None]) for i, t, *_ in DOCS]
    c, b, t = Counter(), Counter(), Counter()
    for _, h, w in seq:
        if not h:
            c.update(w)
            b.update(zip([0, *w], w))
            t.update(zip([0, 0, *w], [0, *w], w))
    n, v = sum(c.values()), len(c)
    z, follow = n + 0.5 * (v + 1), Counter(c) | Counter({0: c[None]})
    k = lambda h: lm.TAU / max(follow[h], n / lm.COMMON)
    want = []
    for i, h, w in seq:
        base = sum(math.log10((c[x] + 0.5) / z) for x in w)
        s, two = 0.0, [0, 0, *w]
        for g, x, y in zip(two, two[1:], w):
            before = c[None] if x == 0 else b[g, x]
            s += math.log10((t[g, x, y] + k(x) * b[x, y] + lm.NU * (c[y] + 0.5) / z) / (before + k(x) * follow[x] + lm.NU))
        want.append((str(i), h, len(w), sum(c[x] > 0 for x in w), n, round(base, 6), s))
    mine = sorted((str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got.itertuples())
    for a, w in zip(mine, sorted(want)):
        assert a[:6] == w[:6] and abs(a[6] - w[6]) < 0.02 * w[2]
    assert lm.score(docs.limit(0), held).count() == 0
    empty = lm.score(docs, F.lit(True)).toPandas()
    assert (empty.base_score == 0).all() and (empty.train_tokens == 0).all()


def test_banded_alignment():
    def brute(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(2)
    for _ in range(1500):
        a = [r.randrange(4) for _ in range(r.randrange(1, 30))]
        b = [x if r.random() < 0.9 else r.randrange(4) for x in a if r.random() < 0.95] or [1]
        for most in (0, 2, 8, 29):
            m = min(most, max(len(a), len(b)))
            d = brute(a, b)
            assert near_dups.banded_distance(a, b, m) == (d if d <= m else m + 1)


def test_near_dups(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(12)]
    passage = [r.choice(words) for _ in range(80)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w[:90] + ["new"] + w[92:]).upper() if i % 2 else " ".join(w)) for i, w in enumerate(base[:6])]
    rows += [(200 + i, " ".join(w[:120] + passage)) for i, w in enumerate([[r.choice(words) for _ in range(120)] for _ in range(8)])]
    rows += [(300, None), (301, ""), (None, rows[3][1]), (5, rows[5][1]), (400, "one two"), (401, "one two")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cluster_id int")
    got = near_dups.cluster(d).toPandas()
    of = {i: c for i, c in zip(got.doc_id, got.cluster_id) if i == i}
    assert [of[100 + i] for i in range(6)] == list(range(6)) and of[301] == of[300] == 300 and of[401] == 400
    assert all(of[200 + i] == 200 + i for i in range(8)) and got[got.doc_id.isna()].cluster_id.tolist() == [3]
    kept = near_dups.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted([*range(12), *range(200, 208), 300, 400])
    assert near_dups.cluster(d.limit(0)).count() == 0


def test_quality_rules(docs, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality_rules.judge(docs, labels.limit(0)).toPandas()
    assert len(got) == len(DOCS) and not got[got.n_words == 0].kept.any()
    texts = [t or "" for _, t, *_ in DOCS] + ["a b c a b c\nx\n\nx\r\nx\n x", "é#|<>\n \né#|<>"]
    raw = [t.encode() for t in texts]
    s = quality_rules.rule_stats(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, t in enumerate(texts):
        w, seen, dup, cover = WORD.findall(t), set(), 0, set()
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        for k, x in enumerate(tri):
            cover |= {k, k + 1, k + 2} if tri.count(x) > 1 else set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup, seen = dup + (line in seen), seen | {line}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(set(w)))
        assert tuple(s[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_reply_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "hi"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 0.5, "assistant", None), ("t", 4, 3, 2.0, "user", "<|im_end|>\n\\<\\|x"), ("u", 1, 9, None, None, "orphan"), ("c", 1, 2, 0.0, "user", "x"), ("c", 2, 1, 0.0, "user", "y")]
    m = spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string")
    paths = chat.branches(m, keep=2)
    got = {(r.tree, r.branch): [x for _, x in sorted(r.p)] for r in paths.groupBy("tree", "branch").agg(F.collect_list(F.struct("depth", "id")).alias("p")).collect()}
    assert got == {("t", 4): [1, 3, 4], ("t", 2): [1, 2], ("u", 1): [1]}
    text = chat.format_branches(m, chat.branches(m)).where("tree = 't'").first()
    assert chat.parse(text.formatted) == [("user", "hi"), ("assistant", ""), ("user", "<|im_end|>\n\\<\\|x")]
    assert len(text.loss_spans) == 1 and text.loss_spans[0].start == text.loss_spans[0].end
    long_ = spark.createDataFrame([("l", i, i - 1 if i else None, 0.0, "a\nb", "t") for i in range(70)], m.schema)
    assert len(chat.parse(chat.format_branches(long_, chat.branches(long_)).first().formatted)) == 70
    assert chat.branches(m.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "only"), (-5, "u", "neg"), (6, "http://f", "z" * 100000)], "page_id long, url string, html string")
    rows = warc.archives(pages, archive_bytes=200)
    got = {r.page_id: r for r in warc.records(rows).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].html) == ("revisit", 2, "response", "<p>é</p>")
    assert (got[3].refers_to, got[4].payload_bytes, got[None].html, got[-5].record_type) == (4, 0, "only", "response")
    assert got[6].payload_bytes == 100000 and warc.records(warc.archives(pages.limit(0))).count() == 0
    warc.save(rows, str(tmp_path))
    assert sum(1 for p in tmp_path.glob("*.warc.zst") for _ in warc.open_archive(p.read_bytes())) == 7
    many = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body>page number {i} of a site with a menu</body></html>" * 5) for i in range(600)], pages.schema)
    content = warc.archives(many).first().content
    assert int.from_bytes(content[:4], "little") == warc.SKIPPABLE_DICTIONARY


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2], name
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(texts.values())) == len(texts)  # no exact copy is left


@pytest.mark.parametrize("shared,own_words,edits", [(22, 8, 1), (18, 12, 5), (20, 10, 6)])
def test_near_dups_behind_a_foreign_member(spark, shared, own_words, edits):
    """Near copies that share only buckets which a passage of many documents fills are found, down to similarity 0.8."""
    r = random.Random(8)
    word = iter(f"q{i}" for i in range(10**6))
    passage = [next(word) for _ in range(shared)]
    rows, pairs = [], []
    for i in range(300):  # foreign first members have the smallest ids
        rows.append((i, " ".join(passage + [next(word) for _ in range(own_words)])))
    for i in range(300):
        own = [next(word) for _ in range(own_words)]
        other = list(own)
        for at in r.sample(range(own_words), edits):
            other[at] = next(word)
        rows += [(1000 + 2 * i, " ".join(passage + own)), (1001 + 2 * i, " ".join(passage + other))]
        pairs.append((1000 + 2 * i, 1001 + 2 * i))
    got = near_dups.cluster(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").cluster_id
    assert all(got[a] == got[b] == a for a, b in pairs)
    assert all(got[i] == i for i in range(300))


def test_near_dups_recall_by_similarity(spark):
    """Scattered edits in 10, 15 and 19 % of the words, against alignment of the planted pairs."""
    r = random.Random(4)
    rows, pairs = [], []
    for share, n in ((0.10, 100), (0.15, 100), (0.19, 100)):
        for _ in range(n):
            i = 2 * len(pairs)
            a = [f"v{r.randrange(20000)}" for _ in range(200)]
            b = list(a)
            for at in r.sample(range(200), int(200 * share)):
                b[at] = f"z{r.randrange(20000)}"
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            pairs.append((i, share))
    got = near_dups.cluster(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").cluster_id
    found = {s: np.mean([got[i] == got[i + 1] for i, x in pairs if x == s]) for s in (0.10, 0.15, 0.19)}
    assert found[0.10] >= 0.99 and found[0.15] >= 0.95 and found[0.19] >= 0.85, found


def test_near_dups_row_identity(spark):
    """Null ids, an id with two texts, and negative ids lose no different text and keep no copy."""
    r = random.Random(6)
    text = [[f"u{r.randrange(9000)}" for _ in range(60)] for _ in range(8)]
    near = lambda i: " ".join(text[i][:30] + ["other"] + text[i][31:])
    t = [" ".join(x) for x in text]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (None, near(0)), (7, t[2]), (7, t[3]), (9, near(3)), (-5, t[4]), (4, t[4]), (6, near(4)), (8, t[5]), (8, near(5)), (1, t[6]), (None, near(6))]
    kept = near_dups.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((x.doc_id, next(i for i in range(8) if x.text in (t[i], near(i)))) for x in kept)
    assert got == Counter([(None, 0), (None, 1), (7, 2), (7, 3), (-5, 4), (8, 5), (1, 6)])
