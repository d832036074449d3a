"""Importance resampling, periodic runs and decontamination against plain versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from warpspark.llm import decontamination, periodic_runs, queries, resampling
from warpspark.llm.common import LETTER, Words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_decontamination"])
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert found == sorted(duck.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall(), key=repr)


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resampling(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_matches_a_plain_version(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ñ", "x" * 150, "y" * 129, "日本"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 19, 20, 40, 300])))) for i in range(400)]
    rows += [(500 + i, "same words again and again, " * 6) for i in range(300)]  # ties and repeats
    rows += [(7, rows[7][1]), (7, rows[7][1]), (900, None), (901, ""), (902, "...!"), (None, "no id " * 30), (903, "long " * 30_000)]
    target = spark.createDataFrame([(1, "w1 w2 w3 Éa"), (2, None), (3, "x" * 150 + " ñ w5")], "item_id long, text string")
    want = plain_resampling(rows, [r["text"] for r in target.collect()], 30, 20)
    assert max(r[4] or 0 for r in want) > 100
    for parts in (1, 7):
        found = resampling.resample(docs(rows).repartition(parts), target, percent=30)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert resampling.resample(docs([]), target).count() == 0
    empty = resampling.resample(docs(rows[:30]), target.limit(0)).collect()
    assert sorted((tuple(r) for r in empty), key=repr) == plain_resampling(rows[:30], [], 5, 20)


def test_segments_split_ties_by_doc_id():
    rng = np.random.default_rng(1)
    score, ids = rng.integers(0, 5, 1000), rng.permutation(1000)
    order = np.lexsort((ids, -score))
    at = order[[50, 300, 301, 302, 700, 990]]
    got = resampling.segments(score, ids, score[at], ids[at])
    place = np.empty(1000, int)
    place[order] = np.arange(1000)
    assert (got == np.searchsorted(np.sort(place[at]), place, "right")).all()


def test_checksums_of_joined_words():
    texts = ["Hello wörld foo".encode(), b"", b"a", b"x " * 3, b"q" * 200 + b" zz " + b"y" * 129 + b" k" + b" m" * 3]
    w = Words(texts, lower=True, letters=LETTER)
    for k, (at, bucket) in enumerate(resampling.feature_buckets(w)):
        for i, b in zip(at.tolist(), bucket.tolist()):
            assert zlib.crc32(b" ".join(w.raw[w.start[j] : w.end[j]] for j in range(i, i + k + 1))) % 10000 == b


def plain_runs(t):
    """All maximal runs by trying each period at each place."""
    out = []
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(t[i : i + n - p] == t[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_run_digest(i, text):
    w = (text or "").encode().split()
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = plain_runs(w)
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(b" ".join(kept)))


def test_runs_of_random_sequences():
    rng, total = random.Random(1), 0
    for _ in range(400):
        seqs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.choice([0, 1, 2, 5, 10, 30, 60]), rng.choice([1, 2, 2, 3])
            s = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n > 8:
                root, a = [rng.randrange(k) for _ in range(rng.randint(1, 4))], rng.randrange(n)
                s[a : a + 30] = [root[x % len(root)] for x in range(len(s[a : a + 30]))]
            seqs.append(s)
        first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
        found = periodic_runs.runs(periodic_runs.SuffixArray(np.array(sum(seqs, []), np.int64), first), first)
        want = [(s + int(first[i]), n, q) for i, t in enumerate(seqs) for s, n, q in plain_runs(t)]
        assert list(zip(*(x.tolist() for x in found))) == want, seqs
        total += len(want)
    assert total > 200


def test_common_prefixes_and_order():
    s = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 9])
    first = np.array([0, 6, 11])
    sa = periodic_runs.SuffixArray(s, first)
    suffix = [(0 if i < 6 else 1, *s[i : 6 if i < 6 else 11].tolist()) for i in range(11)]
    assert [suffix[i] for i in sa.order] == sorted(suffix)
    assert (sa.order[sa.place] == np.arange(11)).all()
    assert sa.common(np.array([0, 0, 6, 5]), np.array([2, 6, 8, 0])).tolist() == [3, 0, 2, 0]


def test_run_query_matches_a_plain_version(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"]) < 6000]
    rows += [(10_000 + i, "a b c d " * 7 + "e\n" * i + " tail tail") for i in range(25)]
    rows += [(11_000, None), (11_001, ""), (11_002, " \n"), (None, "x " * 9), (11_003, "é\x1cü é\x1cü " * 4), (11_003, "é\x1cü é\x1cü " * 4)]
    want = sorted((plain_run_digest(*r) for r in rows), key=repr)
    for parts in (1, 5):
        found = periodic_runs.digest_runs(docs(rows).repartition(parts))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert periodic_runs.digest_runs(docs([])).count() == 0
    n = 60_000
    long = periodic_runs.find_runs(docs([(1, "u v " * n + "w")])).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 2 * n, 2)] and long["collapsed"] == "u v w"


def plain_contamination(rows, items, size=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, text in rows:
        w, hit, ids = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    ids |= found - {None}
        named = ",".join(sorted(map(str, ids)))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_matches_a_plain_version(spark, docs, monkeypatch):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices("ab cd EF gh Éi j1 kl".split(), k=n))
    items = [(i, some(rng.choice([10, 12, 30]))) for i in range(12)]
    shared = some(15)
    items += [(100 + i, f"{some(3)} {shared}, {some(3)}") for i in range(5)]  # items that share windows
    items += [(200, None), (201, "!?"), (202, "one, Two; three"), (203, "quick"), (203, "Éi four five six"), (None, "no id but ten words are in here as well"), (5, items[5][1])]
    rows = [(i, some(rng.choice([0, 3, 9, 10, 60]))) for i in range(60)]
    rows += [(100 + i, f"{some(20)} -- {rng.choice(items)[1]} {some(9)} {items[3][1].upper()}") for i in range(40)]
    rows += [(300 + i, f"aa {shared} bb") for i in range(30)]  # copies of one text
    rows += [(400, None), (401, ""), (402, "one two three"), (402, "one two three"), (None, "quick brown"), (403, "no id but ten words are in here as well"), (404, "x " * 20_000 + items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contamination(rows, items)
    assert sum(r[5] for r in want) > 70
    for parts, sent in ((1, 1 << 21), (5, 0)):  # anchors sent to all, and joined by a shuffle
        monkeypatch.setattr(decontamination, "SENT", sent)
        found = decontamination.digest_contamination(docs(rows).repartition(parts), table)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    full = decontamination.find_contamination(docs(rows[60:62]), table)
    assert {"words", "source", "hits", "items"} <= set(full.columns) and full.count() == 2
    long_only = [x for x in items if len(words(x[1])) >= 10]
    found = decontamination.digest_contamination(docs(rows), table.filter("item_id < 200"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_contamination(rows, [x for x in long_only if x[0] is not None and x[0] < 200])
    none = decontamination.digest_contamination(docs(rows[:9]), table.limit(0)).collect()
    assert sorted((tuple(r) for r in none), key=repr) == plain_contamination(rows[:9], [])
    assert decontamination.digest_contamination(docs([]), table).count() == 0


def test_decontamination_runs_no_python(spark):
    plan = queries.op13_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
