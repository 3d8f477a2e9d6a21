"""Operator 9 against a brute-force version."""

import random
import re

import numpy as np
import pytest
from corpora import corpus
from tidemill.llm import common as C
from tidemill.llm import substring_dedup as S
from tidemill.llm.substring_dedup import WINDOW, dedup_substrings, strip_substrings

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [(i, SPLIT.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for s in range(len(w) - WINDOW + 1):
            k = tuple(w[s : s + WINDOW])
            if i is not None:
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - WINDOW + 1):
            if i is not None and least[tuple(w[s : s + WINDOW])] < i:
                gone.update(range(s, s + WINDOW))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)  # several blocks
    rows = corpus(seed, 250)
    assert found(spark, rows) == brute(rows)


def long_rows(n, seed=3):
    """Texts of up to 3,000 words with long shared passages, copies and near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(rng.randrange(13, 900))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(3, 1500))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 12)
            at = rng.randrange(len(w))
            w[at:at] = p[a : a + rng.randrange(1, 900)]
        if rows and rng.random() < 0.3:
            w = rng.choice(rows)[1].split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_long_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 100_000)
    rows = long_rows(60)
    assert found(spark, rows) == brute(rows)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 400)
    monkeypatch.setattr(C, "CHUNK_BYTES", 1)
    rows = long_rows(25, 4)
    group = S.slices.__globals__["pa"].table({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    cut = [(p.num_rows, len(own)) for p, _, own in S.slices(group)]
    assert cut
    import pyarrow as pa

    batch = pa.record_batch({"id": pa.array([7]), "text": pa.array([" ".join(f"v{i % 997}" for i in range(3000))])})
    (_, places, own), = list(S.slices(pa.Table.from_batches([batch])))
    assert len(own) > 5
    covered = np.zeros(len(places[1]), bool)
    for offset, s in own:
        starts, _, _ = s.windows()
        covered[offset + starts] = True
    assert covered[: len(places[1]) - WINDOW + 1].all()
    assert found(spark, rows) == brute(rows)


def test_repeated_ids_with_other_texts_own_their_windows(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(20)) for c in "tu")
    rows = [(1, t), (2, t), (2, u), (3, u), (None, t), (None, u), (4, None), (5, "")]
    assert found(spark, rows) == brute(rows)


def test_thue_morse_words_are_told_apart(spark):
    """Two words that every polynomial hash modulo a power of two confuses."""
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    assert x != y and len(x) == 2048
    tail = " ".join(f"k{i}" for i in range(12))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")]
    assert [r[2] for r in found(spark, rows)] == [0, 0, 13]


def test_strip_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, 1, "p", "q", 9), (2, f"a  {text} b", 2, "r", "s", 8), (None, text, 3, None, "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, windows int, block string, id string, c0 long")
    got = strip_substrings(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], (2, "a b", 2, "r", "s", 8), rows[2]], key=repr)


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert strip_substrings(spark.createDataFrame([], "doc_id long, text string, n_chars int")).count() == 0
