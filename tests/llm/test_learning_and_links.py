"""URL cascade, language model, near duplicates and vectors against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ziplore.llm import language_model, near_dedup, urls, vector_dedup, words
from ziplore.llm.components import components

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://a.net", "http://a.net/", "x://A.B.Example.NET/en/1?q", "https://example.net/en",
    "http://example.com/de/x", "http://notexample.com/de/x", "http://q.org/fr/#x", "http://org/fr/", "http://a.net:80/", "http://casino-win.example.org",
    "http://www.free-bets.q.example.org/x", "http://casinowin.example.org/", "://?", "http://a.b/c://d.net/", "http://É.net/ü", "http://..net//",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(n + p, v) for n, p, v in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
    labels = host.split(".")
    listed = any(set(label.split("-")) & set(urls.LISTED_WORDS) for label in labels)
    return host, path, rule[0], rule[1] or ("block" if listed else "allow")


def test_urls_against_plain_rules(spark):
    rows = list(enumerate(URLS)) + [(6, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_hit", F.lit(1))
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url), r.url
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_hosts_of_any_depth_equal_the_sql(spark, tmp_path):
    """Listed parents far up and far down in hosts of 9 to 700 labels, against the query's SQL."""
    import duckdb

    from ziplore.llm.queries import OP4_SQL, op4_url_filters

    deep = [(n, at) for n in (2, 8, 9, 10, 61, 140, 700) for at in (None, 0, 1, n // 2, n - 1)]
    rows = [(i, "http://" + ".".join("x-spam" if k == at else f"h{k}" for k in range(n)) + "/a?b") for i, (n, at) in enumerate(deep)]
    rows += [(1000, "http://" + "." * 50 + "/"), (1001, None), (1002, "http://" + "a." * 139 + "org/fr/x"), (1000, "http://" + "." * 50 + "/")]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP4_SQL})").fetchall())
    assert sorted(tuple(r) for r in op4_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert [w[4] for w in want[: len(deep)]] == ["allow" if at is None else "block" for _, at in deep]


@pytest.mark.parametrize("words", [urls.MAX_CASCADE_WORDS, 0])
def test_given_list_by_cascade_and_beyond_its_size(spark, monkeypatch, words):
    monkeypatch.setattr(urls, "MAX_CASCADE_WORDS", words)
    monkeypatch.setattr(urls, "MAX_STATED", 0 if not words else 1000)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 40, F.lit(".site"), F.col("id") % 7, F.lit(".xy/")).alias("url"))
    listed = spark.createDataFrame([("site3.xy",), ("h5.site5.xy",), ("other.xy",), (None,)], "key string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, listed).collect()}
    assert got == {i: "block" if i % 7 == 3 or (i % 40 == 5 and i % 7 == 5) else "allow" for i in range(300)}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many false positives, so many levels
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    cascade = urls.build_cascade(keys.filter("key % 5 = 0"), keys)
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.holds(F.col("key")) != (F.col("key") % 5 == 0)).count() == 0


def test_word_hashes_against_split():
    texts = ["", " ", None, "a", " a b ", "a  b", "b a", "ab", "é x\u00a0y", "x" * 70000 + " y", "a\tb\nc\x0bd", "\x1c a", "aB Ab"] * 40
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab \n😀é") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    known = {}
    for text, own in zip(texts, words.bags(pa.array(texts, pa.string())), strict=True):
        split = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert len(split) == len(own)
        assert all(known.setdefault(w, h) == h for w, h in zip(split, own.tolist()))
    assert len(set(known.values())) == len(known)
    tails = [t for _, tails, _ in words.hashed_texts(pa.array(texts, pa.string()), lower=True) for t in tails.tolist()]
    want = [w.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert tails == [(w[-2] if len(w) > 1 else 0) * 256 + w[-1] for w in want]


# --- language model -------------------------------------------------------


def test_language_model_counts_and_gain(spark):
    rng = random.Random(2)
    heads = [["ba", "be", "bi", "bo"], ["ko", "ku", "ki", "ka"]]
    rows = []
    for i in range(300):
        words = heads[i % 2]
        rows.append((i, " ".join(rng.choice(words) + ("X" if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 80)))))
    rows += [(300, None), (301, ""), (302, "ÀB ab\tAB\n unseen" + "y" * 3000), (None, "ba"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(1))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in rows:
        if not held(i):
            counts.update(split(t))
    total = sum(counts.values())
    share = total + 0.5 * (len(counts) + 1)
    got = language_model.score_documents(docs).collect()
    want = Counter()
    for i, t in rows:
        tokens = split(t)
        base = sum(math.log10((counts[w] + 0.5) / share) for w in tokens)
        want[(i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    fresh = [r for r in got if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh) + 0.1 * sum(r.n_tokens for r in fresh)
    assert language_model.score_documents(docs.limit(0)).count() == 0


def test_looked_up_tokens_count_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 9} c{i} a") for i in range(60)], "doc_id long, text string")
    key = lambda r: (r.doc_id, r.n_known, round(r.base_score, 9))
    whole = sorted(map(key, language_model.score_documents(docs).collect()))
    counts = language_model.count_tokens(docs)
    small = language_model.vocabulary(counts, head=3)
    assert 0 < len(small.head) <= 3
    monkeypatch.setattr(language_model, "vocabulary", lambda c: small)
    assert sorted(map(key, language_model.score_documents(docs).collect())) == whole


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(language_model.WEIGHT_ROWS, language_model.CLASSES)).astype(np.float32)
    stream = rng.integers(1, 1 << 60, 50)
    rows = language_model.features(stream, np.array([20, 50]))
    assert rows.max() < language_model.WEIGHT_ROWS
    assert np.allclose(np.exp(language_model.log_softmax(weights, rows)).sum(axis=1), 1, atol=1e-4)


def test_rows_follow_the_counted_words():
    """Twenty thousand words are told apart, as are as many pairs."""
    space = language_model.Space.of(200_000, 20_000)
    stream = np.random.default_rng(1).integers(1, 1 << 60, 20_000)
    rows = language_model.features(stream, np.array([20_000]), space)
    assert rows.max() < space.rows
    assert min(len(np.unique(rows[:, f])) for f in (1, 2, 3)) > 12_000
    assert len(np.unique(language_model.inner_features(stream, np.array([20_000]), space)[:, 1])) > 12_000
    assert language_model.Space.of(10, 3) == language_model.Space()
    most = language_model.Space.of(1 << 50, 1 << 45)
    assert 4 * (most.rows * language_model.CLASSES + most.inner_rows * language_model.GROUPS) < 62e6


def _streams(texts):
    """Streams of tokens of some texts."""
    return list(language_model.token_streams(pa.array(texts)))


def test_what_one_task_learns_of_a_word_is_kept(spark):
    """A word of one task in eight has the weights that this task learned, not an eighth of them."""
    rng = random.Random(4)
    plain = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(70)]
    rows = [(None, t) for t in plain] + [(None, "qqzz a " * 200)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    vocab = language_model.vocabulary(language_model.count_tokens(docs))
    alone = docs.filter(F.col("text").contains("qqzz"))
    (stream, ends), = _streams(["qqzz a"])
    row = language_model.features(stream, ends, vocab.space)[1, 1]
    start, learned, kept = (w[0][row] for w in (language_model._start(vocab), language_model.train(alone, vocab), language_model.train(docs, vocab)))
    at = language_model.classes_of(stream, vocab)[1]
    assert learned[at] - start[at] > 0.5
    assert kept[at] - start[at] > 0.5 * (learned[at] - start[at])


def test_context_tells_words_of_one_ending_apart(spark):
    """Words with one ending, each after a word of its own: their groups are learned, and add up to one."""
    rng = random.Random(5)
    frequent = [f"f{i}" for i in range(20)]
    texts = []
    for _ in range(400):
        some = []
        for _ in range(20):
            i = rng.randrange(30)
            some += rng.choices(frequent, k=4) + [f"before{i}", f"w{i}ba"]
        texts.append(" ".join(some))
    docs = spark.createDataFrame([(None, t) for t in texts[:300]], "doc_id long, text string")
    vocab = language_model.vocabulary(language_model.count_tokens(docs))
    assert np.allclose(vocab.groups.sum(axis=1), vocab.mass[: language_model.ENDINGS])
    learned, start = language_model.train(docs, vocab)[1], language_model._start(vocab)[1]
    (stream, ends), = _streams(texts[300:])
    rows = language_model.inner_features(stream, ends, vocab.space)
    assert np.allclose(np.exp(language_model.log_softmax(learned, rows)).sum(axis=1), 1, atol=1e-4)
    known = np.isin(stream, _streams(["w0ba " + " ".join(f"w{i}ba" for i in range(30))])[0][0][:-1])
    groups = language_model.groups_of(stream)
    gain = language_model._softmax_of(learned, rows, groups) - language_model._softmax_of(start, rows, groups)
    assert known.sum() == 2000 and gain[known].mean() > 0.2


# --- near duplicates ------------------------------------------------------


def weighted_jaccard(a, b):
    def bag(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = min(5, len(words))
        return {k: 1 + math.log(v) for k, v in Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).items()} if n else {}
    x, y = bag(a), bag(b)
    both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return both / (sum(x.values()) + sum(y.values()) - both) if x and y else 0.0


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DAMPING", 0.0)  # a small table has no rare shingles
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for group in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for copy in range(rng.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3]) if copy else 0):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [None, "", " \n", "short", "short", "one two three", "one two  three", texts[0], "z" * 9000 + " q" * 9]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cluster_id", F.lit("clash"))
    parent = {i * 3: i * 3 for i in range(len(texts))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if weighted_jaccard(texts[i], texts[j]) >= near_dedup.THRESHOLD:
                a, b = sorted((find(i * 3), find(j * 3)))
                parent[b] = a
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.cluster_id for r in got if r.doc_id is not None} == {i: find(i) for i in parent}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.cluster_id) for r in got)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_go_on_by_hubs(spark, monkeypatch):
    """A star of near copies whose outer texts are no copies of each other, without the small-bucket path."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 1)
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(30):
        own = list(base)
        for k in rng.sample(range(300), 5):
            own[k] = str(rng.random())
        texts.append(" ".join(own))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.cluster_id for r in near_dedup.near_duplicates(docs).collect()} == {0}


def test_copies_of_copies_in_a_large_bucket(spark, monkeypatch):
    """In their only bucket, a near copy of a near copy of the hub joins, though it is none of the hub itself."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    words = [f"w{i}" for i in range(200)]
    inner = [w + "x" if i in (50, 100, 180) else w for i, w in enumerate(words)]
    outer = [w + "y" if i in (20, 75, 150) else w for i, w in enumerate(inner)]
    other = [w + "z" for w in words]
    texts = [" ".join(t) for t in (words, inner, outer, other)]
    assert weighted_jaccard(texts[0], texts[2]) < near_dedup.THRESHOLD <= weighted_jaccard(texts[1], texts[2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")
    )
    common = spark.sparkContext.broadcast(np.ones(near_dedup.COUNTERS, np.float32))
    nodes = near_dedup.sketches(docs, common).withColumn("buckets", F.array(F.lit(7).cast("long")))
    got = {r.id: r.component for r in near_dedup._components(nodes, docs, common).collect()}
    assert {i: got.get(i, i) for i in range(4)} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_left_rows_meet_all_members_of_the_hubs_component(spark, monkeypatch):
    """One large bucket, blocks of two rows, and a single link that no hub sees."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    text = lambda k: " ".join(f"w{k}_{i}" for i in range(60))
    texts = [text(k) for k in range(11)]
    texts += [texts[3] + " tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")
    )
    common = spark.sparkContext.broadcast(np.ones(near_dedup.COUNTERS, np.float32))
    nodes = near_dedup.sketches(docs, common)
    large = docs.select(
        F.lit(7).cast("long").alias("bucket"), "doc_id",
        F.when(F.col("doc_id") < 7, 0).otherwise(F.col("doc_id")).cast("long").alias("component"),
        (F.col("doc_id") >= 7).alias("left"),
    )
    assert [tuple(r) for r in near_dedup._across(large, nodes, docs, common).collect()] == [(3, 11)]


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(0)
    sampler = near_dedup.Sampler()
    for share in (0.4, 0.8, 0.95):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            kept = int(600 * 2 * share / (1 + share))
            b = np.r_[a[:kept], rng.integers(0, 1 << 63, 600 - kept).astype(np.uint64)]
            w = np.where(rng.random(600) < 0.4, 2.3, 1).astype(np.float32)
            both = w[:kept].sum()
            errors.append((sampler.draw(a, w) == sampler.draw(b, w)).mean() - both / (2 * w.sum() - both))
        assert abs(np.mean(errors)) < 0.025


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(7, 3), (3, 7), (9, 9)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 540)} | {3: 3, 7: 3}


# --- vectors --------------------------------------------------------------


@pytest.mark.parametrize("shard", [8192, 60])
def test_vectors_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 400)] + 0.18 * rng.normal(size=(400, 16))
    x[200:230] = x[200]  # copies
    rows = [(i, x[i].tolist(), int(i % 3 == 0)) for i in range(400)]
    odd = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [None] + [1.0] * 15, [math.inf] + [0.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, x[0].tolist(), None), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(400) % 3 == 0
    near = (unit @ unit.T >= vector_dedup.THRESHOLD - 1e-12) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    component = np.arange(400)
    while True:
        least = np.array([min(component[i], component[near[i]].min(initial=400)) for i in range(400)])
        if (least == component).all():
            break
        component = least
    got = vector_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert [by[i].n_links for i in range(400)] == near.sum(axis=1).tolist()
    assert [by[i].component_id for i in range(400)] == component.tolist()
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in [*range(1000, 1007), 2000])
    assert by[None].n_links == 0 and by[None].kept
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_a_longer_vector_leaves_the_others_of_its_label_comparable(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0, 0.0], "a"), (4, [2.0, 0.0, 0.0], "a"), (5, [1.0], "a")]
    got = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)
    ]
