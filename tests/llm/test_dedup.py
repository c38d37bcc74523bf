"""Near-dedup, substring dedup, mixing and the pipeline against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, forest, minhash, mixing, sql, suffix_dedup
from tessera.llm.common import Workspace

DIR = "/root/testdata/sf0.001"


def words(rnd, n):
    return [rnd.choice("kalo mina tero sula grusch pfalt wenk drotz oueau ieux aillon vorta".split()) + str(rnd.randint(0, 9)) for _ in range(n)]


def union(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "ONE_TASK", bound)
    rnd = random.Random(9)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "t")).collect()}
    want = union({x for e in links for x in e}, links)
    assert out == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in links)}


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    return union(sets, pairs)


def near_corpus():
    rnd = random.Random(11)
    texts = {}
    for _ in range(12):
        base = words(rnd, rnd.randint(8, 120))
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 99))
            texts[len(texts) * 3] = " ".join(w)
    texts[1000], texts[1001], texts[1002], texts[1003] = None, "", "two words", "Two  words"
    texts[1004] = texts[1005] = " ".join(words(rnd, 20_000))
    return texts


def test_minhash(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    texts = near_corpus()
    rows = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(None, "x", "y"), (1002, "two words", "again")], "doc_id long, text string, class_id string")
    out = minhash.classify(rows).collect()
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == brute_classes(texts)
    assert [r.kept for r in out if r.doc_id is None] == [True] and len(out) == len(texts) + 1
    kept = minhash.remove(rows)
    want = {i for i, c in brute_classes(texts).items() if i == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want) and kept.columns == rows.columns
    assert minhash.classify(rows.limit(0)).count() == 0


def test_minhash_of_rows_that_share_an_id(spark, monkeypatch):
    """Their texts are one document; of them the first stays; columns may have any names."""
    monkeypatch.setattr(minhash, "LARGE", 2)
    rnd = random.Random(21)
    a, b, c = (words(rnd, 60) for _ in range(3))
    near = [*b[:30], "other", *b[31:]]
    texts = [(5, a), (5, b), (9, near), (2, c), (7, c), (8, c), (12, a), (20, words(rnd, 40))]
    rows = spark.createDataFrame([(i, " ".join(t), "x", "y", "z", "q") for i, t in texts] + [(2, None, "x", "y", "z", "q")], "doc_id long, text string, _stays string, id string, rows string, row string")
    assert {r.doc_id: r.class_id for r in minhash.classify(rows).collect()} == {5: 5, 9: 5, 12: 5, 2: 2, 7: 2, 8: 2, 20: 20}
    kept = minhash.remove(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == sorted([(5, min(" ".join(a), " ".join(b))), (2, ""), (20, " ".join(texts[-1][1]))])


@pytest.mark.parametrize("block", [4, 1500])
def test_minhash_with_weights(spark, monkeypatch, block):
    """With counts as weights, links are those of the weighted similarity."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(23)
    texts = {}
    for g in range(10):
        base, times = words(rnd, rnd.randint(10, 40)), rnd.randint(1, 4)
        for _ in range(6):
            w = base * times + words(rnd, 5) + (base if rnd.random() < 0.5 else [])
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "edit"
            texts[len(texts)] = " ".join(w)
    sets = {i: minhash.shingles(t) for i, t in texts.items()}
    counts = {i: dict(zip(s[0].tolist(), s[1].tolist(), strict=True)) for i, s in sets.items()}

    def like(a, b):
        keys = set(a) | set(b)
        return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)

    want = union(texts, [(i, j) for i in texts for j in texts if i < j and like(counts[i], counts[j]) >= 0.8])
    assert want != brute_classes(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.class_id for r in minhash.near_classes(rows, weighted=True).collect()} == want


def test_minhash_finds_chains_past_the_stars(spark, monkeypatch):
    """With no round of stars, the exact comparison of what is left finds every link."""
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    texts = near_corpus()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classify(rows).collect()} == brute_classes(texts)


def test_dart_minhash_estimates_weighted_jaccard():
    e = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = np.linspace(0.2, 3, 100)
    b = a[::-1].copy()
    s = minhash.dart_minhash([e, e, e[:0]], [a, b, a[:0]], 3000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert (minhash.dart_minhash([e], [a], 3000)[0] == s[0]).all() and not s[2].any()


def brute_cut(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if seen.get(b[j : j + 50], i) < i:
                gone[j : j + 50] = b"\1" * 50
        for j in range(len(b) - 49):
            seen.setdefault(b[j : j + 50], i)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def repeat_corpus():
    """Shared passages, repetitive texts, cuts within characters, and texts over two letters, whose heads are all common."""
    rnd = random.Random(13)
    shared = [" ".join(words(rnd, n)) for n in (6, 9, 15, 60)]
    texts = {i: " ".join(words(rnd, rnd.randint(0, 30)) + [rnd.choice(shared)] * rnd.randint(0, 2) + words(rnd, rnd.randint(0, 30))) for i in range(0, 120, 2)}
    texts |= {1: "a" * 300, 3: "a" * 49, 5: "a" * 50, 7: None, 9: "", 11: "é" * 40, 13: "xé" + "é" * 60, 15: texts[8], 17: "\0" * 80 + "q", 19: "\0" * 60, 121: shared[3] * 40}
    for i in range(300, 360):
        texts[i] = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 200))) * rnd.choice([1, 2]) + rnd.choice(["", "a" * rnd.randint(0, 300), "ab" * rnd.randint(0, 150), " " * 90])
    return texts


@pytest.mark.parametrize("batches,groups,block,hot", [(1, 1, 1 << 20, False), (3, 2, 500, True), (6, 1, 3000, False)])
def test_suffix_dedup(spark, monkeypatch, batches, groups, block, hot):
    monkeypatch.setattr(suffix_dedup, "GROUPS", groups)
    monkeypatch.setattr(suffix_dedup, "BATCHES", batches)
    monkeypatch.setattr(suffix_dedup, "LEAST_SHARDS", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    if hot:  # heads are hot from two suffixes on
        heads = suffix_dedup.hot_heads
        monkeypatch.setattr(suffix_dedup, "hot_heads", lambda d, w: heads(d, w, 100))
    texts = repeat_corpus()
    rows = spark.createDataFrame([(i, t, "clash", "s", "r", "i", "t") for i, t in texts.items()], "doc_id long, text string, n_spans string, spans string, row string, id string, _text string")
    whole = suffix_dedup.remove(rows, batches=batches)
    assert whole.columns == ["doc_id", "text", "spans", "row", "id", "_text", "kept", "n_bytes", "n_removed", "n_spans"]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in whole.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).collect()}
    assert out == brute_cut(texts)
    odd = suffix_dedup.digests(spark.createDataFrame([(None, "z" * 60), (None, "z" * 60), (4, "z" * 60), (4, "z" * 60)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in odd] == [0] * 4
    assert suffix_dedup.digests(rows.limit(0)).count() == 0


@pytest.mark.parametrize("window", [20, 50, 120])
def test_common_prefixes_are_those_of_the_bytes(window):
    """The array is in the order of all bytes from the anchor on, and neighbours' common prefixes are right."""
    texts = [(t or "").encode() for t in repeat_corpus().values()]
    run, *_ = suffix_dedup.suffixes(texts, np.arange(len(texts)), window)
    strings = suffix_dedup.Strings(run)
    begin = run.begin
    own = [bytes(run.data[b + a : b + n]).ljust(window, b"\0") for b, a, n in zip(begin, run.anchor, run.lengths, strict=True)]
    order, common = suffix_dedup.suffix_array(len(own), strings.after, -(-window // 8))
    ordered = [own[i] for i in order]
    assert ordered == sorted(own)
    for k in range(1, len(ordered)):
        want = next((i for i, (x, y) in enumerate(zip(ordered[k - 1], ordered[k], strict=True)) if x != y), window)
        assert min(int(common[k]), window) == want
    # Bits of hits are those of a comparison of all windows.
    first: dict[bytes, int] = {}
    windows = [[bytes(run.data[b + i : b + i + window]) for i in range(w)] for b, w in zip(begin, run.windows, strict=True)]
    for doc, own in zip(run.doc.tolist(), windows, strict=True):
        for w in own:
            first[w] = min(doc, first.get(w, doc))
    _, hits = suffix_dedup.matches(run, len(run.doc))
    assert [int(h) for h in hits] == [sum((first[w] < doc) << i for i, w in enumerate(own)) for doc, own in zip(run.doc.tolist(), windows, strict=True)]


def test_levels_merge_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark, 4)
    sizes = []
    for i in range(7):
        index.add(spark.createDataFrame([(i, " ".join(words(random.Random(i), 30)))], "doc_id long, text string"))
        sizes.append([s for s, _, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]


def brute_links(vectors):
    good = {}
    for i, label, v in vectors:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[i] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    ids = {i for i, _, _ in vectors if i is not None}
    return degree, union(ids, links)


@pytest.mark.parametrize("block,sample,others", [(40, 20_000, 0), (2000, 20_000, 0), (2000, 60, 300)])
def test_forest(spark, monkeypatch, block, sample, others):
    """Also where the sample supports few splits, so that leaves are split further by samples of their own."""
    monkeypatch.setattr(forest, "BLOCK", block)
    whole = forest.near_links
    monkeypatch.setattr(forest, "near_links", lambda v: whole(v, leaf=20, sample=sample))
    rnd = np.random.default_rng(1)
    vectors = []
    for c in range(25):
        base = rnd.standard_normal(24)
        for _ in range(int(rnd.integers(1, 30)) if c else 150):
            vectors.append((len(vectors) * 2, int(c % 3), (base + rnd.standard_normal(24) * rnd.choice([0, 0.05, 0.15])).astype(float).tolist()))
    vectors += [(1, None, [1.0, 0.0]), (3, 1, None), (5, 1, [0.0, 0.0]), (7, 1, [1.0, None]), (9, 1, [float("nan"), 1.0]), (11, 1, [1.0, 0.0]), (13, 1, [2.0, 0.0]), (15, 2, [1.0, 0.0]), (17, 1, [float("inf"), 1.0]), (19, 1, []), (None, 1, [1.0, 0.0])]
    vectors += [(5001 + 2 * i, 2, (rnd.standard_normal(5) * [1, 1, 1, 1, 0.1]).tolist()) for i in range(others)]
    rows = spark.createDataFrame([(*v, "clash") for v in vectors], "vec_id long, label int, embedding array<float>, component_id string")
    out = {r.vec_id: r for r in forest.classify(rows).collect()}
    degree, root = brute_links(vectors)
    ids = [i for i, _, _ in vectors if i is not None]
    found = sum(out[i].n_links for i in ids) / max(1, sum(degree.values()))
    assert 0.999 <= found <= 1 and all(out[i].n_links <= degree[i] for i in ids)
    assert {i: out[i].component_id for i in ids} == root
    assert out[None].kept and out[None].component_id is None and len(out) == len(vectors)
    assert forest.classify(rows.limit(0)).count() == 0


def test_mixing(spark):
    rnd = random.Random(17)
    rows = [(i, " ".join(words(rnd, rnd.randint(0, 40))), rnd.choice(["en", "en", "en", "de", "fr", None]), rnd.choice(["src1"] * 6 + ["src2", "src3", "other", None]), "clash") for i in range(600)]
    rows += [(600, None, "en", "src1", "c"), (None, "a b", "en", "src1", "c"), rows[5], rows[5], (601, "x " * 30_000, "de", "src2", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot string")
    for name in ("id", "row", "key", "domain", "tokens", "copies", "whole", "rest", "last", "start", "cut", "_key", "_lang", "_source"):
        docs = docs.withColumn(name, F.lit("clash"))
    taken = mixing.mix(docs, mixing.WEIGHTS, 0.4, 2, 3)
    got = taken.collect()
    count = defaultdict(int)
    for i, t, lang, source, _ in rows:
        name = source or ""
        domain = f"domain{int(name[3:]) % 4}" if name.startswith("src") else "other"
        count[domain, lang or "", name] += len((t or "").split())
    budget = math.floor(sum(count.values()) * 0.4)

    def share(amount, children):
        """Water-filling by repeated rounds."""
        given, left = dict.fromkeys(children, 0.0), dict(children)
        while left:
            rate = amount / sum(w for _, w in left.values())
            full = {k: c for k, (c, w) in left.items() if c <= rate * w}
            if not full:
                return given | {k: rate * w for k, (c, w) in left.items()}
            for k, c in full.items():
                given[k] = c
                amount -= c
                del left[k]
        return given

    cap = lambda *p: 2 * sum(n for k, n in count.items() if k[: len(p)] == p)
    quota = {}
    for d, bd in share(budget, {k: (cap(k), mixing.WEIGHTS["domain"].get(k, 1)) for k in {k[0] for k in count}}).items():
        for lang, bl in share(bd, {k: (cap(d, k), mixing.WEIGHTS["lang"].get(k, 1)) for k in {k[1] for k in count if k[0] == d}}).items():
            for s, b in share(bl, {k: (cap(d, lang, k), 1) for k in {k[2] for k in count if k[:2] == (d, lang)}}).items():
                quota[d, lang, s] = b
    held = defaultdict(int)
    for r in got:
        held[r._domain, r.lang or "", r.source or ""] += r._tokens * r._copies
    for k, q in quota.items():
        assert held[k] <= q + 1e-6
        assert q - held[k] < 45 or k[2] == "src2" or count[k] * 2 == held[k]
    assert taken.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(str, mixing.mix(docs, mixing.WEIGHTS, 0.4, 2, 3).collect())) == sorted(map(str, got))
    assert mixing.mix(docs, mixing.WEIGHTS, 9.0, 1).count() >= 600
    assert mixing.mixture(docs.limit(0)).count() == 0


@pytest.mark.parametrize("number", [1, 4, 6])
def test_sql(spark, number):
    import duckdb

    from tessera.llm import queries

    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    name = next(n for n in queries.queries() if n.startswith(f"op{number}_"))
    ours, theirs = queries.queries()[name](spark, DIR).toPandas(), db.sql(getattr(sql, f"OP{number}")).df()
    assert sorted(map(str, ours[sorted(ours)].values.tolist())) == sorted(map(str, theirs[sorted(ours)].values.tolist()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    work = Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = work.keep(stage(spark, before, DIR))
        if name != "byte_bpe":
            assert docs.columns == before.columns
        if name == "minhash_near_dedup":
            own = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, c in brute_classes(own).items() if i == c}
        if name == "suffix_array_dedup":
            own = {r.doc_id: r.text for r in before.collect()}
            want = brute_cut(own)
            assert {r.doc_id: len(r.text.encode()) for r in docs.collect()} == pytest.approx({i: w[0] - w[1] for i, w in want.items()}, abs=6)
        if name == "mixing":
            assert 0 < docs.count() < before.count()
    assert {r.doc_id for r in docs.collect()} <= set(texts) and docs.columns == ["doc_id", "n_tokens", "ids"]
    assert corpus_pipeline.run(spark, DIR).count() == docs.count()
