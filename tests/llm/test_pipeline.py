"""The pipeline on a small corpus; each stage's decisions take effect."""

import collections
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_operators import lines_by_hand, words

BASE = " ".join(f"w{i * 7 % 101}x{i}" for i in range(120))
PASSAGE = " ".join(f"p{i}" for i in range(50))
ITEM = " ".join(f"question{i}" for i in range(15))


def test_stages(spark, tmp_path):
    own = lambda k, n=40: " ".join(f"t{k}u{i}" for i in range(n))
    rows = [(1, BASE), (2, BASE), (3, BASE + " tail"), (4, f"{own(4)} {PASSAGE} {own(44)}"), (5, f"{PASSAGE} {own(5)}"), (6, f"{own(6)} {ITEM}"), (7, "too short"), (8, "again " * 50), (9, own(9)), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k1 string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < 4:
            assert now.columns == docs.columns
            seen.append({r.doc_id: r.text for r in now.collect()})
    assert set(seen[0]) == {1, 2, 3, 4, 5, 6, 9}
    assert set(seen[1]) == {1, 4, 5, 6, 9}
    assert seen[2][4] == f"{own(4)} {own(44)}" and seen[2][5] == own(5) and seen[2][9] == own(9)
    assert set(seen[3]) == {1, 4, 5, 9}
    assert {r.doc_id for r in now.collect()} == {1, 4, 5, 9}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string"


@pytest.mark.parametrize("case", ["empty", "copies", "no benchmark"])
def test_edges(spark, tmp_path, case):
    own = lambda k: " ".join(f"t{k}u{i}" for i in range(40))
    rows = [] if case == "empty" else [(5, own(1))] * 4 + [(3, own(1)), (8, own(2)), (8, own(2)), (9, None), (10, ""), (11, " ".join(f"long{i}" for i in range(100_000)))]
    spark.createDataFrame([(i, t, None, None, None, "clash", "clash") for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    items = [] if case == "no benchmark" else [(1, "nowhere to be found")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == (set() if case == "empty" else {3, 8, 11})


def test_a_run_leaves_one_table(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    spark.createDataFrame([(1, BASE, "en", "s", 5, "", "")], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(set(os.listdir(folder)) - before) == 1


def brute_force(rows, items):
    """The pipeline's pieces, stage by stage, by plain loops: doc_id, start, length, crc, doc_tokens."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    gone = lines_by_hand([(i, t, s) for i, t, s in rows], 20)
    docs = []
    for i, text, source in rows:
        w = words(text)
        counts = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if counts[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        sizes = [len(words(x)) for x in (text or "").split("\n") if words(x)]
        removed = sum(sizes[k] for k in gone[i])
        if len(w) < 10 or 100 * len(covered) > 20 * len(w) or (removed and len(w) - removed < 0.2 * len(w)):
            continue
        place, out = 0, []
        for x in text.split("\n"):
            if not words(x) or place not in gone[i]:
                out.append(x)
            place += bool(words(x))
        docs.append((i, "\n".join(out)))
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in docs for w in [words(t)]}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    text_of = dict(docs)
    for a in grams:
        for b in grams:
            if a < b and (text_of[a] == text_of[b] or len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) > 0):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    docs = [(i, t) for i, t in docs if find(i) == i]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, t in docs for w in [words(t)] for k in range(len(w) - 34))
    kept = []
    for i, t in docs:
        w = words(t)
        cut = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept.append((i, " ".join(x for j, x in enumerate(w) if j not in cut) if cut else t))
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [fold(t)] if w for k in range(max(1, len(w) - 9))}
    pieces = set()
    for i, t in kept:
        w = fold(t)
        if any(tuple(w[k : k + len(p)]) == p for p in windows for k in range(len(w) - len(p) + 1)):
            continue
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for size in [4096] * (len(ids) // 4096) + [1 << b for b in range(11, -1, -1) if len(ids) % 4096 >> b & 1]:
            pieces.add((i, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)))
            at += size
    return pieces


def test_against_brute_force(spark, tmp_path):
    random = np.random.default_rng(11)
    vocabulary = [f"word{i}" for i in range(4000)]
    make = lambda n: [str(x) for x in random.choice(vocabulary, n)]
    passages, footer, rows = [make(45) for _ in range(4)], "see the terms of this site for more", []
    for i in range(130):
        body = make(int(random.integers(5, 150)))
        if i % 6 == 0:
            body[len(body) // 2 : len(body) // 2] = passages[i % 4]
        lines = [" ".join(body[k : k + 12]) for k in range(0, len(body), 12)]
        if i % 3 == 0:
            lines.insert(len(lines) // 2, footer)
        if i % 17 == 0:
            lines.append(f"{ITEM} and more")
        rows.append((i, "\n".join(lines), f"s{i % 2}"))
    for i in range(30):  # near copies and copies
        w = rows[i][1].split(" ")
        if i % 2:
            w[len(w) // 2] = f"edit{i}"
        rows.append((500 + i, " ".join(w), rows[i][2]))
    rows += [(900, None, "s0"), (901, "", None), (902, "again " * 40, "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "", "") for i, t, s in rows], COLUMNS)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, [(1, ITEM)]) and len({r[0] for r in got}) > 60
