"""Quality, URL rules, SimHash, SpotSigs, substring removal and the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import components, near_copies, quality, simhash, spotsigs, substring_dedup, url_rules
from flowloom.llm.common import KeyFilter, Scratch
from flowloom.llm.components import connected_components

DATA = "/root/testdata/sf0.001"


def join_sets(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- shared


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_LINKS", small)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    want = join_sets(300, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(df.filter("false"), Scratch(spark, "test")).count() == 0


def test_key_filter(spark):
    kept = KeyFilter.of(spark.range(0, 5000, 5), "id")
    assert kept.test(np.arange(0, 5000, 5)).all() and kept.test(np.arange(1, 5000, 5)).mean() < 0.01


# ---------------------------------------------------------------- op1


def test_figures_of_odd_texts():
    for t in (b"", b" ", "é".encode(), b"x " * 9999):
        f = quality.figures(t)
        assert len(f) == quality.N_FIGURES and np.isfinite(f).all()


def test_quality(spark, odd_documents, no_documents):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    out = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out.values())
    assert np.mean([out[r["doc_id"]]["predicted"] == r["quality"] for r in held]) >= 0.9
    odd = quality.scored(odd_documents, model, carry=("doc_id", "lang", "n")).collect()
    assert len(odd) == odd_documents.count() and not any(r["score"] != r["score"] for r in odd)
    assert quality.scored(no_documents, model).count() == 0
    none = quality.learn(docs, labels.filter("false"))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {quality.DEFAULT_PRIOR}


def test_labels_of_the_held_out_fold_are_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == quality.HELD_OUT_FOLD, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, turned)
    assert all((x == y).all() for x, y in zip(a.weights, b.weights, strict=True))


def test_non_negative_risk_separates():
    rng = np.random.RandomState(0)
    good, bad = rng.randn(600, quality.N_FIGURES), rng.randn(200, quality.N_FIGURES) + 3
    model = quality.fit(good[:300], np.concatenate([good[300:], bad[:100]]), 0.75)
    assert (model.score(rng.randn(200, quality.N_FIGURES)) >= 0.7).mean() > 0.95
    assert (model.score(bad[100:]) < 0.7).mean() > 0.95


# ---------------------------------------------------------------- op3


def test_url_parts_and_rules(spark):
    urls = [
        ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://b.com/en/1", "b.com", "/en/1", "com/en/", "block"),
        ("https://notcom/en/1", "notcom", "/en/1", None, None),
        ("https://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
        ("https://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("https://x.org?/es/", "x.org", "", None, None),
        ("ftp://x.org/es/#a://b", "x.org", "/es/", "org/es/", "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    out = {r["page_id"]: r for r in url_rules.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_rules.judge(df.filter("false")).count() == 0
    assert url_rules.judge(df.unionByName(df)).count() == 2 * len(urls)


def test_mined_rules_against_counting(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "MIN_ROWS", 3)
    rng = random.Random(6)
    rows = [(rng.sample(["a", "b", "c", "d", "e"], 3),) for _ in range(200)]
    rows = [(t, "block" if {"a", "b"} <= set(t) or "e" in t and rng.random() < 0.95 else "allow") for (t,) in rows]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r["tokens"]), r["verdict"]) for r in url_rules.mine_rules(df, 0.02, 0.9).collect()}
    from itertools import combinations

    want = set()
    for size in (1, 2, 3):
        for combo in combinations("abcde", size):
            held = [v for t, v in rows if set(combo) <= set(t)]
            for v in ("block", "allow"):
                n = held.count(v)
                if n >= 0.02 * len(rows) and n >= 3 and n >= 0.9 * len(held) and not any((s, v) in want for k in range(1, size) for s in combinations(combo, k)):
                    want.add((combo, v))
    assert got == want
    hits = {tuple(sorted(r["tokens"])): r["verdict"] for r in url_rules.match_rules(df.select("tokens").distinct(), url_rules.mine_rules(df, 0.02, 0.9)).collect()}
    assert set(hits) == {tuple(sorted(t)) for t, _ in rows if any(set(c) <= set(t) for c, _ in want)}


def labels_by(df, words):
    return df.select("url", F.when(F.col("url").rlike(words), "block").otherwise("allow").alias("verdict"))


def test_pages_labelled_block_come_back_as_block(spark):
    # 'bets' is labelled block, some under net/de/, where a given rule allows; {word:bets} and broad allow rules compete
    urls = [f"http://x{i % 7}.net/fr/{i}" for i in range(500)] + [f"http://bets.net/fr/{i}" for i in range(12)] + [f"http://bets.net/de/{i}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_rules.judge(df, labels_by(df, "bets")).filter("rule is null").collect()
    assert {r["verdict"] for r in out if "bets" in r["host"]} == {"block"}
    assert {r["verdict"] for r in out if "bets" not in r["host"]} == {"allow"}


def test_rare_words_have_rules_at_every_size(spark):
    urls = [f"http://x{i % 7}.net/fr/{i}" for i in range(400)] + [f"http://{w}.org/fr/{i}" for w in ("bets", "casino-win") for i in range(2)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for part in (df, df.filter("page_id >= 360")):
        out = url_rules.judge(part, labels_by(part, "bets|casino")).filter("host like '%.org'").collect()
        assert [r["verdict"] for r in out] == ["block"] * 4


def test_its_own_labels_come_back(spark):
    """Pages labelled by the given rules, judged by mined rules alone."""
    out = url_rules.judge(spark.read.parquet(f"{DATA}/pages.parquet")).filter("rule is not null").collect()
    for verdict in ("block", "allow"):
        own = [r["mined_verdict"] or "allow" for r in out if r["verdict"] == verdict]
        assert own.count(verdict) >= 0.9 * len(own) > 0


def test_a_long_path_that_recurs_is_one_item(spark):
    path = "/".join(a + b for a in "abcde" for b in "stuvwxyz")
    urls = [f"http://a.com/en/{path}"] * 5 + [f"http://b{i}.org/fr/x" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = df.select(url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens"), F.when(F.col("url").contains("com"), "block").otherwise("allow").alias("verdict"))
    rules = url_rules.mine_rules(rows, only="block").collect()
    assert len(rules) == 1 and len(rules[0]["tokens"]) == 43


def test_long_urls_and_null_ids(spark):
    rows = [(None, "http://a.com/" + "x/" * 5000 + "7" * 5000), (None, None), (1, "http://a.com/" + "y" * 100_000), (1, "http://a.com/" + "y" * 100_000)]
    out = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == 4 and {r["verdict"] for r in out} == {"allow"} and sum(r["page_id"] is None for r in out) == 2


# ---------------------------------------------------------------- op4


def test_fingerprint_by_the_definition():
    from xxhash import xxh64_intdigest

    for text in ("", "One", "one TWO", "A b  c\td e\x0bf É", "x " * 50, " ".join(map(str, range(300)))):
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in text.split()]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text.encode()) == want


def test_anchors_cover(spark):
    rng = np.random.RandomState(0)
    a = rng.randint(0, 1 << 62, 300, dtype=np.uint64) ^ (rng.randint(0, 4, 300).astype(np.uint64) << np.uint64(62))
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ra, ka, ha = simhash.anchors(a)
    rb, kb, _ = simhash.anchors(b)
    for i in range(300):
        assert set(ka[(ra == i) & ha]) & set(kb[rb == i])


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(8)
    bases = [rng.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in bases for _ in range(12)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = {}
    for i, p in enumerate(signed):
        distinct.setdefault(p, i)
    df = spark.createDataFrame(list(distinct.items()), "fp long, rep long")
    found = connected_components(simhash.links(df), Scratch(spark, "test")).collect()
    got = {r["node"]: r["component"] for r in found}
    reps = list(distinct.values())
    pairs = [(i, j) for i in reps for j in reps if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3]
    want = join_sets(len(prints), pairs)
    assert {i: got.get(i, i) for i in reps} == {i: want[i] for i in reps}


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    zero = {r["component_id"] for r in rows if r["fp"] == 0}
    assert zero == {1}
    assert simhash.near_duplicates(no_documents).count() == 0


# ---------------------------------------------------------------- op8


def spot_sets(df):
    own = spotsigs.classes(df).select("doc_id", "class_id", "signatures").collect()
    return [(r["doc_id"], r["class_id"], set(r["signatures"])) for r in own]


def test_chains(spark):
    df = spark.createDataFrame([(0, "Green THE old house of, a stone")], "doc_id long, text string")
    from pyspark.sql import functions as F

    words = [("^", "green", "old", "house"), ("the", "old", "house", "stone"), ("of", "stone", None, None), ("a", "stone", None, None)]
    want = spark.createDataFrame(words, "a string, b string, c string, d string").select(F.xxhash64("a", "b", "c", "d").bitwiseAND(F.lit(0xFFFFFFFF)))
    assert spot_sets(df)[0][2] == {r[0] for r in want.collect()}


def test_edits_and_next(spark, odd_documents, no_documents):
    rows = spotsigs.fingerprint_edits(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = {}
    for r in odd_documents.filter("doc_id is not null").collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    ids = sorted(texts, reverse=True)
    for r in rows:
        if r["doc_id"] is None:
            assert r["near_next"] is None
            continue
        following = texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        want = {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t in texts[r["doc_id"]] for n in following}
        assert r["edited_sha256"] in want and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert spotsigs.fingerprint_edits(no_documents).count() == 0
    one = spotsigs.fingerprint_edits(odd_documents.filter("doc_id = 0")).first()
    assert one["near_next"] == 1.0


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "IDS_PER_RANGE", 10)
    ids = sorted(random.Random(1).sample(range(10_000), 95))
    got = {r["id"]: r["next"] for r in spotsigs.next_ids(spark.createDataFrame([(i, 1) for i in ids], "id long, n long")).collect()}
    assert got == {i: ids[k - 1] for k, i in enumerate(ids)}


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_pairs(spark, threshold):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "a", "in", *(f"w{i}" for i in range(40))]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(5):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id int, text string")
    reps = {c: s for _, c, s in spot_sets(df)}
    want = {(a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) >= threshold * len(reps[a] | reps[b]) - 1e-12}
    got = {tuple(sorted((r["rep_a"], r["rep_b"]))) for r in spotsigs.near_pairs(df, threshold).collect()}
    assert got == want and want


# ---------------------------------------------------------------- op10


def brute_removal(rows, window):
    first, docs = {}, []
    for d, t in rows:
        words = (t or "").encode().split()
        docs.append((d, words))
        for i in range(len(words) - window + 1) if d is not None else ():
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in docs:
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1) if d is not None else ():
            if first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = True
        out.append((d, len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [4, 10])
def test_removal(spark, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "CLAIMS_PER_PART", 5)
    rng = random.Random(window)
    rows = []
    for i in range(100):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        if rows and rng.random() < 0.7:
            old = rng.choice(rows)[1].split()
            a = rng.randint(0, max(0, len(old) - 1))
            words += old[a : a + rng.randint(0, 30)] + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        rows.append((i, " ".join(words)))
    rows += [(200, "x " * 60), (201, "x " * 25), (202, "x " * 61 + "y"), (7, "x " * 40), (203, ""), (203, "a b")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, digest=True).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(rows, window)


def test_removal_of_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = substring_dedup.remove_repeats(odd_documents, digest=True).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(rows, 50)
    assert substring_dedup.remove_repeats(no_documents).count() == 0
    kept = substring_dedup.remove_repeats(odd_documents, carry=("doc_id", "text", "lang")).collect()
    assert all(r["kept"] == (r["text"] or "") for r in kept if not r["n_removed"])


def test_a_false_claim_removes_nothing():
    shard = substring_dedup.Shard([b" ".join(b"w%d" % i for i in range(80))], 50)
    words = [b"w%d" % i for i in range(10, 59)] + [b"other"] * 30
    assert shard.locate(words) == []
    assert shard.locate([b"x", *(b"w%d" % i for i in range(10, 60)), b"y"]) == [(1, 51)]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch = Scratch(spark, "test")
    stages, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.table(stage(spark, now, DATA))
        assert now.columns == docs.columns, name
        stages.append(now)
    model = quality.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scored(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == good
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    ids = sorted(texts)
    sets = [set(near_copies.shingles(texts[i].encode()).tolist()) for i in ids]
    root = join_sets(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b]))])
    assert {r["doc_id"] for r in stages[2].collect()} == {ids[r] for r in set(root)}
    left = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {d: (n, h) for d, _, n, h in brute_removal(left, 50)}
    for r in stages[3].collect():
        n, digest = want[r["doc_id"]]
        assert hashlib.sha256(" ".join(r["text"].encode().decode().split()).encode()).hexdigest() == digest or not n and r["text"] == dict(left)[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    packed = corpus_pipeline.STAGES[-1][1](spark, stages[3], DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in stages[3].collect()}


@pytest.mark.parametrize(("common_rows", "block", "share"), [(5, 2048, 8), (2, 2048, 8), (50, 3, 1), (50, 2, 1 << 40)])
def test_near_copies_by_five_words(spark, monkeypatch, common_rows, block, share):
    """Copies with some other words, most of them over 3 SimHash bits apart, against all pairs."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "COMMON_ROWS", common_rows)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_copies, "SPANNING_SHARE", share)
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for edits in (0, 0, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(base)), edits * len(base) // 120):
                copy[at] = "new"
            rows.append((len(rows), "one line that all texts have " + " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, "two words"), (len(rows) + 2, "two  words")]
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if len(set(sets[a]) & set(sets[b])) >= 0.8 * max(1, len(set(sets[a]) | set(sets[b])))]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert sum(bin(prints[a] ^ prints[b]).count("1") > simhash.MAX_BITS for a, b in pairs) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, DATA).collect())
    assert kept == sorted(set(join_sets(len(rows), pairs)))


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 1), (1, a, 1), (1, a, 2), (2, a, 3), (1, b, 4), (0, b + " end", 5), (None, a, 6), (None, "lone text", 7), (None, "lone text", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, df, DATA).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (0, b + " end"), (None, "lone text")], key=str)


def test_pipeline_stages_of_odd_rows(spark, odd_documents, no_documents):
    import corpus_pipeline

    for table in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, table, DATA)
            if name != "packing":
                assert out.columns == table.columns
            out.collect()
    assert corpus_pipeline.quality_stage(spark, odd_documents, DATA).columns == odd_documents.columns
