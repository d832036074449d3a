import random
import re
import zlib

import corpus_pipeline as P
import numpy as np
from test_duplicates import prose, sets_of
from test_rules_and_models import base_spans, plain_cost, plain_verdicts
from tokenizers import Tokenizer

from warpspark.llm import bpe, secrets

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.schema, {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.schema == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    a, b, c, d = kept.values()
    assert len(a) > len(b) >= len(c) == len(d)
    sets = {i: sets_of(t, 5) for i, t in a.items()}
    gone = set(a) - set(b)
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert all(any(near(sets[i], sets[j]) for j in a if j < i or j in gone and j != i) for i in gone)
    left = sorted(b)
    assert not any(near(sets[i], sets[j]) for k, i in enumerate(left) for j in left[:k] if len(sets[i] & sets[j]))
    seen = set()
    for i in sorted(b):
        w = b[i].split()
        cover = set()
        for k in range(len(w) - 19):
            t = tuple(w[k : k + 20])
            cover |= set(range(k, k + 20)) if t in seen else set()
            seen.add(t)
        assert [x for k, x in enumerate(w) if k not in cover] == c.get(i, "").split()
    assert not any(base_spans(t) for t in d.values())
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(d)


def test_rows_without_or_with_a_repeated_id(docs, spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = docs([(None, a), (None, a), (1, b), (1, b), (1, "one two"), (2, b + " end"), (None, b + " end"), (None, "few"), (3, c)]).repartition(3)
    first = P.quality(spark, rows, SF)
    key = lambda df: sorted(((r["doc_id"] or 0), r["text"]) for r in df.collect())
    assert key(first) == sorted([(0, a), (0, a), (1, b), (1, b), (2, b + " end"), (0, b + " end"), (3, c)])
    assert first.schema == rows.schema
    second = P.near_duplicates(spark, first, SF)
    assert key(second) == sorted([(0, a), (1, b), (3, c)]) and second.schema == rows.schema
    packed = P.pack(spark, P.secret_redaction(spark, P.repeated_passages(spark, second, SF), SF), SF)
    assert {r["doc_id"] for r in packed.collect()} >= {1, 3}


def plain_cut(rows):
    """(id, text) without the words of windows that begin earlier; the white space after a kept word stays."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(m[0] for m in words[k : k + 20])
            if window in seen:
                gone |= set(range(k, k + 20))
            seen.add(window)
        ends = [m.start() for m in words[1:]] + [len(text)]
        cut = "".join(text[m.start() : e] for k, (m, e) in enumerate(zip(words, ends)) if k not in gone) if gone else text
        if cut.split():
            out[i] = cut
    return out


def plain_redacted(text, ranks):
    spans = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
    for m in re.finditer(r"\bpwd: (\S+)", text):
        if plain_cost(m[1], ranks) >= 9:
            spans.append(m.span(1))
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_matches_a_plain_chain(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(rng, 40)
    rows = []
    for i in range(110):
        text = "\n".join(prose(rng, 12) for _ in range(rng.randint(2, 9)))
        text += f"\n{passage}" if i % 5 == 0 else ""
        text += f"\npwd: {'x7$Kq' if i % 2 else 'xkcd'}{rng.randrange(10**6)}Zr& token = 'abcd{i}efgh'" if i % 4 == 0 else ""
        rows.append(text)
        if i % 6 == 0:  # near copies
            w = text.split(" ")
            w[len(w) // 2] = "changed"
            rows += [" ".join(w), text]
    rows += ["#$%& x| " * 30 + prose(rng, 60) + f" k{i}" for i in range(12)] + [None, "", "few words"]
    rng.shuffle(rows)
    full = [(3 * i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t or ""), "g", 1, 2, "p") for i, t in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, `group` string, keys int, component long, __places string"
    spark.createDataFrame(full, names).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    verdicts = plain_verdicts([r[:4] for r in full])
    a = {r[0]: r[1] for r in full if verdicts[r[0]]}
    assert 60 < len(a) < len(full) - 10
    sets = {i: sets_of(t, 5) for i, t in a.items()}
    group = {i: i for i in a}
    for i in a:
        for j in a:
            if j < i and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    b = {i: a[i] for i in a if group[i] == i}
    c = plain_cut(b.items())
    ranks = secrets.word_ranks(bpe.default_vocabulary())
    d = {i: plain_redacted(t, ranks) for i, t in c.items()}
    assert len(a) > len(b) and b != c and c != d

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in d.items()}
    packed = P.run(spark, str(tmp_path)).collect()
    by_doc, by_window = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(d)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes()), (i, d[i])
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, __row int, __id int, __text int, __nth int, __places int, __place_doc int, x int"
    row = (1, " ".join(f"w{i}" for i in range(60)), None, None, None, *range(7))
    for rows in ([], [row], [row, row, (None, None, *row[2:])]):
        docs = spark.createDataFrame(rows, names)
        for name, stage in P.STAGES[:-1]:
            docs = P.written(stage(spark, docs, SF), f"clash-{name}")
            assert docs.schema.names == spark.createDataFrame(rows, names).schema.names
        assert [(r["doc_id"], r["text"], r["__row"], r["x"]) for r in docs.collect()] == [(1, row[1], 0, 6)] * min(1, len(rows))
        assert P.pack(spark, docs, SF).count() == min(1, len(rows))
