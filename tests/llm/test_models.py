"""Operators 3, 6 and 10: round trips, brute force, and small cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpora import corpus
from pyspark.sql import functions as F
from tidemill.llm import brown_lm, chat_format, html_extract
from tidemill.llm import common as C
from tidemill.llm.common import crc_mod

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("table", [1_000_000, 40, 0])
def test_brown_lm_base(spark, monkeypatch, table):
    monkeypatch.setattr(brown_lm, "TABLE", table)
    rows = corpus(11, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = crc_mod(F.col("doc_id"), 5) == 1
    got = {r.doc_id: r for r in brown_lm.score(docs, docs.where(~held), held).collect()}
    words = {i: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in SPLIT.findall(t or "")] for i, t in rows}
    is_held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    count = Counter(x for i, w in words.items() if not is_held[i] for x in [*w, None])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = got[i]
        tokens = [*w, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held[i], len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0


def test_brown_lm_lowers_a_to_z(spark):
    docs = spark.createDataFrame([(1, "The the THE Été x"), (2, "tHE été Été X new")], "doc_id long, text string")
    held = F.col("doc_id") == 2
    got = {r.doc_id: r for r in brown_lm.score(docs, docs.where(~held), held).collect()}
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in (got[1], got[2])] == [(6, 6, 6), (6, 4, 6)]  # the, Été, x, end; été is another word
    count = {"the": 3, "Été": 1, "x": 1, "end": 1}
    want = sum(math.log10((count.get(x, 0) + 0.5) / (6 + 0.5 * 5)) for x in ("the", "été", "Été", "x", "new", "end"))
    assert math.isclose(got[2].base_score, want, rel_tol=1e-9)


def test_brown_lm_beats_its_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod(F.col("doc_id"), 5) == 1
    r = brown_lm.score(docs, docs.where(~held), held).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def scored(spark, rows, held):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.score for r in brown_lm.score(docs, docs.where(~held), held).collect()}


def test_brown_lm_scores_do_not_depend_on_the_cache(spark, monkeypatch):
    rows, held, seen = corpus(12, 150), crc_mod(F.col("doc_id"), 5) == 1, []
    for table in (1_000_000, 30, 0):
        monkeypatch.setattr(brown_lm, "TABLE", table)
        seen.append(scored(spark, rows, held))
    assert seen[0] == pytest.approx(seen[1], rel=1e-9) and seen[0] == pytest.approx(seen[2], rel=1e-9)


def test_brown_lm_is_a_distribution(spark, monkeypatch):
    """One-word continuations of a history, with one unknown word per class's open mass, sum to at most 1."""
    monkeypatch.setattr(brown_lm, "CORE", 10)
    rng = random.Random(4)
    names, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    rows = [(i, " ".join(x for _ in range(30) for x in (rng.choice(names), rng.choice(verbs)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, rest = brown_lm.learn(docs.select("text"))
    assert (10 ** model.step).sum(axis=1) == pytest.approx(1, abs=1e-9)
    words = dict(zip(model.words.tolist(), model.classes.tolist(), strict=True)) | {r.word % 2**64: r["class"] for r in rest.collect()}
    assert len(words) == 40
    of = lambda x: words[int(C.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x)]))[0])]
    # names and verbs alternate, so clustering must keep them apart, in the core and outside of it
    mixed = {of(x) for x in names} & {of(x) for x in verbs}
    assert sum(of(x) in mixed for x in names + verbs) <= 4


def test_brown_lm_small_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in brown_lm.score(docs, empty, F.lit(False)).collect())
    assert got == [(1, 3, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0)]
    assert brown_lm.score(empty, docs, F.lit(False)).count() == 0


def test_chat_round_trip_and_tree(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (2, 0, "user", "hi"), (2, 1, "assistant", "no\\"), (2, 2, "user", ""), (3, 0, "user", "hi"), (3, 1, "assistant", said), (4, 0, "o:d ### role\\", None), (5, 1, "user", "b"), (5, 0, "user", "a"), (None, 0, None, "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(conv).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    assert read == want
    nodes = chat_format.prefix_tree(conv).orderBy("start").collect()
    assert len(nodes) == 8 and [n.start for n in nodes] == [sum(m.size for m in nodes[:k]) for k in range(8)]
    stream = "".join(n.segment for n in nodes)
    for n in nodes:
        before = "".join(stream[a.start : a.stop] for a in n.attends)
        assert len(before) == n.position
        assert [t for _, t in chat_format.read_turns(before + n.segment)] in [[t for _, t in w][:k] for w in want.values() for k in range(1, 4)]
    assert chat_format.read_back(conv.limit(0)).count() == 0


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=/a>A</a></nav>"
        "<div class='cookie-notice'>We use cookies and more words</div><article><h1>The &amp; title</h1><p>One <b>bold</b>\n  <a href=q>link</a>&nbsp;&#x41;.</p><!-- no --><p>Yes.<br>New</p>"
        "<div class=\"ad\">Buy</div><form><p>Mail</p></form></article><div id=comments><p>First!</p></div><aside>Side</aside><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<article><p>cut off in the mid"), (5, "u", "<nav>only a menu</nav>")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "The & title\nOne bold link A.\nYes.\nNew"
    assert [got[i].text for i in (2, 3, 4, 5)] == ["", "", "cut off in the mid", ""]
    assert got[1].n_chars == len(got[1].text)


def test_html_marks_and_attributes(spark):
    long = html_extract._LONG
    pages = {
        f"<article><p>{long}</p><ul><li>kept</li><li class='comment'>I hate it</li></ul><p class='ad'>Buy now</p></article>": f"{long}\nkept",
        "<article><p title=it's>quoted</p><p title=\"a>b\">more</p></article>": "quoted\nmore",
        f"<nav><a href=x>Home</a></nav><section class='legal-news'><p>{long}</p></section>": long,
        f"<div class='story-side'><p>{long}</p></div><footer>x</footer>": long,
        f"<article><p>{long}</p><table><tr><td>cell<td class=advert>x<tr><th>head</table><dl><dt>term<dd>what</dl></article>": f"{long}\ncell\nhead\nterm\nwhat",
        f"<article><p>{long}<div class=related><p>Other</p></div><p>{long}</p></article>": f"{long}\n{long}",
        "": "",
        "<p": "",
        f"<article><p>{long * 300}</p></article>": long * 300,
    }
    rows = [(i, "u", p) for i, p in enumerate(pages)] * 2
    got = sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect())
    assert got == sorted((i, t) for i, t in enumerate(pages.values())) + [] or got == sorted([(i, t) for i, t in enumerate(pages.values())] * 2)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_extraction_of_pages(spark, sf_dir):
    for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html_extract.html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"<[^>]*\Z", "", article)))
        assert r.text == "\n".join(x for x in blocks if x)


def test_a_counting_task_of_the_language_model_holds_little_however_many_words_it_reads():
    import tracemalloc

    import pyarrow as pa
    from tidemill.llm import brown_lm

    batches = (pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}" for i in range(at, at + 50_000))])], names=["text"]) for at in range(0, 3_000_000, 50_000))
    tracemalloc.start()
    total = sum(sum(b.column("n").to_pylist()) for b in brown_lm._count(batches))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert total == 3_000_000 and peak < 90, peak  # 175 MB with 1,000,000 entries held
