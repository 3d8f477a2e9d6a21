"""Operator 4 against all pairs."""

import random
import re

import pytest
from corpora import corpus
from tidemill.llm import ngram_join
from tidemill.llm.ngram_join import near_duplicates

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: (root(i), links[i]) for i in ids}


def near_copies(seed, n, groups):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(40, 120))]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_matches_all_pairs(spark):
    rows = near_copies(3, 6, 12) + [(i + 1000, t) for i, t in corpus(5, 80)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_dense_group_is_one_class(spark):
    rows = near_copies(4, 150, 1)
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (c, _) in want.items()}


@pytest.mark.parametrize("block", [256, 40])
def test_links_of_dense_groups(spark, monkeypatch, block):
    # copies of one text, each 0.85 like it and most of them less than 0.8 like one another
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(6)
    hub = [f"h{rng.randrange(10**6)}" for _ in range(204)]
    texts = [hub]
    for c in range(150):
        at = rng.randrange(5, 187)
        texts.append([*hub[:at], *(f"c{c}e{k}" for k in range(12)), *hub[at + 12 :]])
    texts += [texts[1], texts[0]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(i + 1000, t) for i, t in near_copies(4, 100, 1)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert got[0][1] == 152


def test_empty_null_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c", 1), (3, "a b c", 2), (4, None, 3), (6, "", 4), (None, "a b c", 5)]
    got = sorted((str(r.doc_id), r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect())
    assert got == [("3", 3, 1), ("4", 4, 0), ("5", 3, 1), ("6", 6, 0), ("None", None, 0)]
