import hashlib
import random
import re

import numpy as np
import pytest

from warpspark.llm import embedding_dedup, ngram_join, substring_dedup
from warpspark.llm.common import drop_scratch, id_filter, passes, written
from warpspark.llm.components import components


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(4)
    rows = []
    common = prose(rng, 60)
    for k in range(60):
        text = prose(rng, rng.randint(3, 250))
        if k % 3 == 0:
            text += "\n" + common
        rows.append(text)
        for _ in range(rng.randint(0, 3)):
            w = text.split()
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = "Changed"
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rows += [None, "", "  \n", "one", "one", "ONE", "two words", "same " * 50, "same " * 60, prose(rng, 30_000)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def sets_of(text, n):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(docs, n, percent):
    rows = corpus()
    sets = {i: sets_of(t, n) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs(rows).repartition(3), n, percent).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("name,value", [("TILE", 5), ("TILE_BYTES", 5_000), ("CROWD", 20)])
def test_ngram_join_tiles_of_crowded_groups(docs, monkeypatch, name, value):
    monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "WHOLE", 10)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 100)
    rng = random.Random(1)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.similar_groups(docs(rows), 4, 85).collect()
    assert {r["component_id"] for r in got} == {0}


@pytest.mark.parametrize("name,value", [("TILE", 2048), ("TILE", 5), ("TILE_BYTES", 5_000), ("PART", 300), ("CROWD", 5)])
def test_ngram_join_counts_all_links(docs, monkeypatch, name, value):
    monkeypatch.setattr(ngram_join, name, value)
    if name != "TILE" or value == 5:
        monkeypatch.setattr(ngram_join, "WHOLE", 10)
    rng = random.Random(2)
    base = prose(rng, 150).split()
    texts = [t for _, t in corpus()]
    for i in range(60):
        w = base[: 150 - i // 2]
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{i}"
        texts += [" ".join(w)] * (1 + i % 3)
    rows = list(enumerate(texts))
    sets = {i: sets_of(t, 4) for i, t in rows}
    similar = lambda a, b: bool(a & b) and 100 * len(a & b) >= 85 * len(a | b)
    wanted = {i: sum(i != j and similar(sets[i], sets[j]) for j in sets) for i in sets}
    assert max(wanted.values()) > 40
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.similar_links(docs(rows + rows[:40]).repartition(3), 4, 85).collect()}
    assert got == wanted


def test_ngram_join_of_words_that_cancel_in_polynomials(docs):
    one, other = thue_morse(10)
    rng = random.Random(6)
    tail = [prose(rng, 3) for _ in range(5)]
    texts = [" ".join(f"{w} {t}" for t in tail) for w in (one, other)]
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"]) for r in ngram_join.similar_links(docs([(0, texts[0]), (1, texts[1])])).collect()}
    assert got == {0: (len(sets_of(texts[0], 4)), 0), 1: (len(sets_of(texts[1], 4)), 0)}


def test_scratch_tables_can_be_dropped(spark):
    drop_scratch(spark)
    kept = written(spark.range(5), "scratch-test")
    assert kept.count() == 5 and drop_scratch(spark) == 1 and drop_scratch(spark) == 0


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3)
    filled, log = id_filter(ids, "id")
    rows = spark.range(3000).selectExpr("id", "xxhash64(id) h").toPandas()
    kept = passes(rows["h"].to_numpy(), filled, log)
    assert kept[::3].all() and kept.sum() < 1250
    assert not passes(rows["h"].to_numpy(), *id_filter(ids.limit(0), "id")).any()


def test_ngram_join_links_of_small_cases(docs):
    rows = [(5, None), (6, ""), (7, "a b"), (3, "A B"), (3, "A B"), (None, "a b"), (None, "x y"), (8, "z")]
    got = sorted((r["doc_id"] or 0, r["n_links"]) for r in ngram_join.similar_links(docs(rows)).collect())
    assert got == [(0, 0), (0, 2), (3, 1), (3, 1), (5, 0), (6, 0), (7, 1), (8, 0)]


def test_ngram_join_small_cases(docs):
    assert ngram_join.similar_groups(docs([])).count() == 0
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs([(5, None), (6, ""), (7, "a b"), (3, "A B"), (3, "A B")])).collect()}
    assert got == {5: (0, 5), 6: (0, 6), 7: (1, 3), 3: (1, 3)}
    rows = sorted(tuple(r)[1:] for r in ngram_join.similar_groups(docs([(None, "a b"), (None, None), (8, "a b c d e")])).collect() if r["doc_id"] is None)
    assert rows == [(0, None), (1, None)]


def test_tile_links_join_all_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 200 - k], rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in rng.integers(0, 40, 50)]
    links = ngram_join.link_tile(np.arange(50), sets, 85)
    group = list(range(50))
    for a, b in links:
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    for i in range(50):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert group[i] == group[j]
    assert len(links) < 50


def windows_removed(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("group,unit", [(1 << 19, 6 << 20), (300, 4000), (4, 1500)])
def test_substring_dedup_matches_brute_force(docs, monkeypatch, group, unit):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "UNIT", unit)
    if group <= 300:
        monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 100)
    rng = random.Random(8)
    one, other = thue_morse(10)
    tail = prose(rng, 30)
    phrase = prose(rng, 12)  # a phrase before many different windows
    rows = [t for _, t in corpus()] + [f"{one} {tail[:60]}", f"{other} {tail[:60]}", f"{one} {tail}", f"{other} {tail}"]
    rows += [f"{phrase} {prose(rng, 15)}" for _ in range(25)]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digest_kept(docs(rows).repartition(3)).collect()}
    assert got == windows_removed(rows, 20)


def test_substring_dedup_cases(docs):
    rows = [(1, "w " * 21), (2, None), (3, ""), (4, "w " * 19), (4, "w " * 19)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.digest_kept(docs(rows)).collect()}
    assert got == {1: 20, 2: 0, 3: 0, 4: 0}
    assert substring_dedup.digest_kept(docs([])).count() == 0
    passage = " ".join(f"p{i}" for i in range(25))
    nameless = {r["doc_id"]: r["n_removed"] for r in substring_dedup.digest_kept(docs([(None, passage), (4, passage)])).collect()}
    assert nameless == {None: 0, 4: 0}
    out = {r["doc_id"]: r for r in substring_dedup.cut_repeats(docs([(1, f"a\n{passage}\nb"), (2, f"c d\n{passage}\ne  f"), (3, None)])).collect()}
    assert out[1]["text"] == f"a\n{passage}\nb" and out[2]["text"] == "c d\ne  f" and out[3]["text"] is None and out[2]["n"] == 7


def test_prefix_plan(spark):
    counted = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 5, 30, 2, 2, 9])], "parent long, prefix long, n long")
    groups, crowded = substring_dedup.plan_prefixes(counted, 10)
    assert sorted(groups) == [(0, 10), (2, 30), (3, 13)] and crowded == [2]


def test_trees_of_suffixes():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    hashes = substring_dedup.mix(words + np.uint64(1))
    at = np.arange(381)
    key, mark = substring_dedup.suffix_letters(hashes, at, 20)
    doc, start = np.zeros(381, np.int64), at.astype(np.int32)
    order, node = substring_dedup.deep_nodes(key, mark, doc, start, 20)
    depth = substring_dedup.common_prefixes(key[order], mark[order], 20)
    letter = substring_dedup.suffix_letters(hashes, np.arange(393), 1)[0] >> np.uint64(56)
    rank = [tuple(letter[i : i + 8].tolist()) for i in order]
    assert rank == sorted(rank)
    for i in range(1, len(order)):
        a, b = words[order[i - 1] :][:20], words[order[i] :][:20]
        same = next((k for k in range(20) if a[k] != b[k]), 20)
        assert depth[i] == (20 if same == 20 else min(same, 8))
    seen = {}
    for i in range(381):
        seen.setdefault(tuple(words[i : i + 20]), i)
    assert all(seen[tuple(words[i : i + 20])] == j for i, j in zip(order, node))


def test_maximal_repeats(docs):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"a b {passage} c"), (2, f"x {passage} y z"), (3, "q " * 5)]
    assert sorted(tuple(r) for r in substring_dedup.maximal_repeats(docs(rows)).collect()) == [(2, 1, 25)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 32))
    x[100:220] = x[0] + rng.normal(size=(120, 32)) * 0.03  # a crowded group
    x[220:300] = x[300:380] + rng.normal(size=(80, 32)) * 0.15
    x[400:410] = x[5]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(600, None, 0), (601, [0.0] * 32, 0), (602, [float("nan")] * 32, 0), (603, [None] + [1.0] * 31, 0), (604, [1.0, 2.0], 0), (605, [2.0, 4.0], 0), (606, [], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors(spark, rows + odd)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    found = sum(got[i]["n_links"] for i in range(500))
    assert found >= 0.98 * close.sum() and all(got[i]["n_links"] <= close[i].sum() for i in range(500))
    assert {got[i]["component_id"] for i in [0, *range(100, 220)]} == {0}
    for i in (600, 601, 602, 603, 606):
        assert got[i]["n_links"] == 0 and got[i]["kept"]
    assert got[605]["component_id"] == 604 and got[605]["n_links"] == 1 and not got[605]["kept"]
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    nameless = embedding_dedup.near_duplicates(vectors(spark, [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in nameless) == [(0, 0, True), (0, 0, True), (3, 0, True)]
    assert embedding_dedup.near_duplicates(vectors(spark, [(1, [1.0, 0.0], 0)])).collect()[0]["kept"]


def test_embedding_dedup_of_two_lengths_and_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "FEW", 50)
    rng = np.random.default_rng(7)
    rows, wanted = [], {}
    for first, d in ((0, 16), (1000, 24), (2000, 5)):
        n = 40 if d == 5 else 150
        x = rng.normal(size=(n, d)).astype(np.float32)
        x[n // 2 :] = x[: n - n // 2] * 3 + rng.normal(size=(n - n // 2, d)).astype(np.float32) * 0.1
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        close = (u @ u.T >= 0.95).sum(axis=1) - 1
        rows += [(first + i, v.tolist(), i) for i, v in enumerate(x)]
        wanted |= {first + i: int(c) for i, c in enumerate(close)}
    rows += [rows[3], rows[3]]
    frame = vectors(spark, rows).selectExpr("vec_id", "embedding", "label AS dim", "label AS codes", "'x' AS digest", "1 AS rep")
    got = embedding_dedup.near_duplicates(frame.repartition(3)).collect()
    assert len(got) == len(rows)
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= n for i, n in wanted.items()) and sum(found.values()) >= 0.97 * sum(wanted.values())


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    group = {}
    for a, b in edges:
        if a != b:
            ga, gb = group.setdefault(a, a), group.setdefault(b, b)
            group = {k: min(ga, gb) if g in (ga, gb) else g for k, g in group.items()}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == group
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
