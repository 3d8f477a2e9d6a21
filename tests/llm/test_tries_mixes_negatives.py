"""Operators 11, 12 and 13 against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemill.llm import conversation_trie, hard_negatives, queries, source_mix

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def spread(spark):
    """Small results stay in many partitions."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- 12: the trie of conversations -------------------------------------------------------------


def digest(role, text):
    return hashlib.md5((hashlib.md5((role or "").encode()).hexdigest() + hashlib.md5((text or "").encode()).hexdigest()).encode()).hexdigest()


def plain_trie(rows):
    """The contract by sets of members."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]  # the remainder of a negative id is negative, as in SQL
    members = defaultdict(set)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(SPACES.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), sum(not kids[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def found_trie(spark, rows):
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    return sorted((tuple(r[c] for c in TRIE) for r in got.collect()), key=repr), got


@pytest.mark.parametrize("seed", range(4))
def test_trie_against_sets_of_members(spread, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(0, 120):
        if rng.random() < 0.85:  # some blocks have no first conversation
            for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
                rows.append((c, t, rng.choice(["user", "assistant"]) if seed % 2 else "user", " ".join(["w"] * rng.randrange(0, 3))))
    got, _ = found_trie(spread, rows)
    assert got == plain_trie(rows)


def test_trie_of_copies_and_long_chains(spread):
    """Copies of one conversation, one that is the beginning of another, and one of 300 turns."""
    rows = [(c, t, "user", f"turn {t} of all") for c in range(200) for t in range(3)]
    rows += [(c, t, "user", f"turn {t} of all" if t < 150 else f"turn {t} of {c}") for c in (300, 301, 302) for t in range(300)]
    got, frame = found_trie(spread, rows)
    assert got == plain_trie(rows)
    points = frame.where("is_point").select("depth").collect()
    assert len(points) < 20 < len(got)


def test_trie_edges(spark):
    """Nulls, ties, repeated rows, empty texts, an id that is negative or null, clashing columns, an empty table."""
    rows = [(None, 0, "user", "nobody's"), (-7, None, None, None), (-7, 1, "user", ""), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, "x", " \n"), (0, 0, "user", "w" * 100_000), (20, 0, "a", "b c"), (21, 3, "a", "b c")]
    got, frame = found_trie(spark, rows)
    assert got == plain_trie(rows)
    clash = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("x").alias(c) for c in "own turns head first h path words seq n ends part left right key depth".split()])
    again = conversation_trie.conversation_trie(clash)
    assert sorted((tuple(r[c] for c in TRIE) for r in again.collect()), key=repr) == got
    none = conversation_trie.conversation_trie(spark.createDataFrame([], TURNS))
    assert none.count() == 0 and none.columns == frame.columns
    # a conversation whose first turns are replaced by none, so that it ends at the root
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    assert found_trie(spark, [(lone, 0, "user", "gone")])[0] == plain_trie([(lone, 0, "user", "gone")])


# --- 13: the mix -----------------------------------------------------------------------------------


def water(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else weights[s] * left / rest for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


DOCS = "doc_id long, source string, text string"


def uneven(seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "Z", "é", "hot", "c"]
    share = dict(zip(names, [2, 30, 5, 10, 1, 200, 20], strict=True))
    return [(i, s, " ".join(["w"] * rng.randrange(0, 40))) for i, s in enumerate(s for s in names for _ in range(share[s]))]


def test_mix_meets_the_targets(spread, monkeypatch):
    monkeypatch.setattr(source_mix, "BUCKET", 7)
    rows = uneven(3)
    docs = spread.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in source_mix.digest(source_mix.positions(docs, source_mix.phased(docs))).collect()}
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, s, text in rows:
        n = len(SPACES.findall(text))
        assert got[i].size == n and got[i].taken in (0, n, 2 * n, 3 * n)
        sizes[s] += n
        taken[s] += got[i].taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert any(want[s] == 3 * sizes[s] for s in sizes) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for i, s, _ in rows:
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    again = source_mix.digest(source_mix.positions(docs.repartition(3), source_mix.phased(docs))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got.values()))


def test_stream_follows_the_schedules(spread):
    """Copies stand end to end, and the part of a source by a time is the integral of its schedule."""
    rows = uneven(4)
    docs = spread.createDataFrame(rows, DOCS)
    early, late = [(0.0, 1.0), (0.5, 1.0), (0.50001, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 1.0)]
    plan = spread.createDataFrame([("hot", 3.0), ("a", 1.0), ("c", 0.0)], "source string, weight double")
    plan = plan.withColumn("schedule", F.when(F.col("source") == "hot", source_mix.schedule(late)).when(F.col("source") == "a", source_mix.schedule(early)))
    stream = source_mix.mixed(docs, plan, most=2).collect()
    at = 0
    for r in stream:
        assert r.start == at
        at += len(SPACES.findall(r.text))
    assert {r.source for r in stream} == {"hot", "a"}
    times = [r["at"] for r in stream]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    assert max(r["at"] for r in stream if r.source == "a") < 0.5001
    size = defaultdict(int)
    for r in stream:
        size[r.source] += len(SPACES.findall(r.text))
    for t in (0.25, 0.5, 0.75):
        done = sum(len(SPACES.findall(r.text)) for r in stream if r.source == "hot" and r["at"] <= t)
        assert abs(done / size["hot"] - t * t) < 0.02


def test_mix_edges(spark, monkeypatch):
    """Repeated rows, null ids, texts and sources, sources without a word, an empty table, clashing columns."""
    monkeypatch.setattr(source_mix, "UNFOLD", 3)
    rows = [(1, "a", "x y")] * 8 + [(None, "a", "z"), (None, None, "z"), (2, None, None), (3, "empty", " \n"), (4, "b", "w " * 100_000), (5, "b", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = source_mix.digest(source_mix.positions(docs)).collect()
    assert len(got) == len(rows)
    assert sorted(r.taken for r in got if r.doc_id == 1) == [6] * 8
    assert all(r.taken == 0 and r.first_at is None and r.first_start is None for r in got if r.size == 0)
    assert [r.target for r in got if r.doc_id == 3] == [0.0]
    clash = docs.select("*", *[F.lit("x").alias(c) for c in "size key n row place bucket buckets areas at start part before weight schedule target repeat taken within ahead s".split()])
    assert sorted(map(repr, source_mix.digest(source_mix.positions(clash)).collect())) == sorted(map(repr, got))
    none = spark.createDataFrame([], DOCS)
    assert source_mix.positions(none).count() == 0 and source_mix.mixed(none).count() == 0
    with pytest.raises(ValueError):
        source_mix.schedule([(0.0, 1.0), (0.5, 1.0)])


# --- 11: hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows):
    """The contract by all pairs, in integers."""
    known = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.append((i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for anchor in sorted({(i, label, tuple(v)) for i, v, label in known if i % 50 == 0}):
        i, label, v = anchor
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, w, m in known if j != i)
        for score, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(i, j, k, x[1], -score, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def found_negatives(spark, rows, tmp_path):
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect())


def clustered(seed, n, dims=8, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    rows = [(int(i), (centres[rng.integers(10)] + rng.normal(size=dims) * 0.3).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]
    same = rows[3][1]
    return [(i, same, 4) if k < copies else (i, v, label) for k, (i, v, label) in enumerate(rows)]


@pytest.mark.parametrize("anchors", [50_000, 5])
def test_negatives_against_all_pairs(spread, tmp_path, monkeypatch, anchors):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = clustered(1, 900, copies=300)
    got = found_negatives(spread, rows, tmp_path)
    assert len(got) > 50 and got == plain_negatives(rows)


def test_negatives_edges(spark, tmp_path):
    """Nulls, NaN, infinities, short and empty vectors, huge components, repeated rows, ties."""
    nan, inf = float("nan"), float("inf")
    rows = clustered(2, 220)
    rows += [(None, rows[0][1], 1), (300, None, 1), (301, rows[1][1], None), (302, [nan] * 8, 1), (303, [inf] * 8, 1), (304, [None] * 8, 1), (305, [], 1), (306, rows[5][1][:3], 2), (350, [], 3)]
    rows += [rows[10]] * 3 + [(50, *rows[50][1:])] * 2 + [(50, rows[51][1], 5)] + [(400, [0.001] * 8, 9), (401, [3e5] * 8, 9), (402, [2e5] * 8, 1)]
    assert found_negatives(spark, rows, tmp_path) == plain_negatives(rows)
    huge = hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e30] * 4, 1), (1, [1e6] * 4, 1), (50, [1.0] * 4, 1)], VECTORS), F.col("vec_id") % 50 == 0)
    assert huge.collect() == []
    none = spark.createDataFrame([], VECTORS).withColumn("slot", F.lit("x"))
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).collect() == []


def test_brackets_hold_and_prune():
    """No score lies outside of its bracket, and bounds from pivots spare exact scores on clustered rows."""
    rng = np.random.default_rng(3)
    vectors = np.round((rng.normal(size=(6, 8)) * 300)[rng.integers(6, size=400)] + rng.normal(size=(400, 8)) * 20)
    most2 = float((vectors**2).sum(axis=1).max())
    lifted = hard_negatives._lifted(vectors, most2)
    pivots = hard_negatives.chosen(lifted, 12)
    assert (lifted**2).sum(axis=1) == pytest.approx(most2)
    far = hard_negatives._distances(lifted, pivots)
    asked = np.concatenate([vectors[:20], np.zeros((20, 1))], axis=1)
    q = hard_negatives._distances(asked, pivots)
    apart, reach = np.abs(q[:, None] - far).max(axis=2), (q[:, None] + far).min(axis=2)
    base = (asked**2).sum(axis=1)[:, None] + most2
    exact = vectors[:20] @ vectors.T
    high, low = (base - apart**2) / 2, (base - reach**2) / 2
    assert (exact <= high + 1).all() and (exact >= low - 1).all()
    fifth = np.sort(exact, axis=1)[:, -5][:, None]
    assert (high < fifth).mean() > 0.2
