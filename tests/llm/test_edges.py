"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import time

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tidemill.llm import brown_lm, chat_format, decontamination, html_extract, language_id, license_scan, ngram_join, piece_codec, quality_rules, substring_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use inside, as columns of the caller.
CLASHES = "row row_key node n sketch block words window windows text_hash has_letter id key n_words n_chunks ratio lower places near word h times class label kept is_copy c0 gone_id start span probe hub".split()
LONG = " ".join(f"Word{i % 5000} and the other words of a line" + (", licensed under the MIT License;" if i % 50 == 0 else "") for i in range(25_000))  # about 1 MB


def labelled(docs):
    return docs.withColumn("lang", F.when(F.length("text") > 20, F.lit("en")))


DOCUMENT_OPS = {
    "op1": lambda d, b: language_id.identify(d, labelled(d)),
    "op2": lambda d, b: decontamination.scan(d, b),
    "op4": lambda d, b: ngram_join.near_duplicates(d),
    "op5": lambda d, b: quality_rules.compression_bands(d),
    "op6": lambda d, b: brown_lm.score(d, d, F.lit(False)),
    "op7": lambda d, b: piece_codec.encode_decode(d, MODEL),
    "op8": lambda d, b: license_scan.scan(d),
    "op9": lambda d, b: substring_dedup.dedup_substrings(d),
}
STAGES = {
    "stage1": lambda d, b: language_id.keep_known(d, labelled(d)),
    "stage2": lambda d, b: ngram_join.one_of_each_class(d),
    "stage3": lambda d, b: substring_dedup.strip_substrings(d),
    "stage4": lambda d, b: decontamination.clean(d, b),
}


def clashing(docs):
    return docs.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def tables(spark):
    copy = " ".join(f"the plain word {i}" for i in range(30))
    rows = [(1, copy), (1, copy), (2, copy), (2, "another text of that id, which is some more words long than the window"), (3, None), (4, ""), (5, " \n\t"), (None, copy), (None, "a text without an id that nobody else has, and so it stays"), (6, LONG), (7, "123 456"), (8, "x" * 200_000)]
    items = [(1, copy), (2, None), (3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), rows


@pytest.mark.parametrize("name", DOCUMENT_OPS)
def test_operators(spark, tables, name):
    docs, items, rows = tables
    found = DOCUMENT_OPS[name](docs, items)
    plain = sorted(map(repr, found.collect()))
    assert len(plain) == len(rows)
    assert sorted(str(r.doc_id) for r in found.select("doc_id").collect()) == sorted(str(i) for i, _ in rows)
    assert sorted(map(repr, DOCUMENT_OPS[name](clashing(docs), items).select(*found.columns).collect())) == plain
    none = DOCUMENT_OPS[name](docs.limit(0), items.limit(0))
    assert none.count() == 0 and none.columns == found.columns


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, tables, name):
    docs, items, _ = tables
    got = STAGES[name](clashing(docs), items)
    assert got.dtypes == clashing(docs).dtypes
    left = sorted(((r.doc_id or 0), (r.text or "")[:20]) for r in got.collect())
    alone = [(0, "a text without an id"), (2, "another text of that")]
    assert all(x in left for x in alone)  # what shares an id, or has none, is not drawn in
    assert STAGES[name](clashing(docs).limit(0), items.limit(0)).count() == 0
    if name == "stage2":
        assert sum(t.startswith("the plain word 0") for _, t in left) == 3  # both rows of id 1, and the one without an id
    if name == "stage4":
        assert not any(t.startswith("the plain word 0") for _, t in left)


def test_last_stage(spark, tables, sf_dir):
    docs, _, rows = tables
    got = corpus_pipeline.encoded(spark, clashing(docs), sf_dir).collect()
    assert len(got) == len(rows) and corpus_pipeline.encoded(spark, docs.limit(0), sf_dir).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (2, 0, None, "hi"), (3, 0, "assistant", ""), (4, 0, "user", LONG), (None, 0, "user", "x"), *[(5, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(300)]]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = conv.select("*", *[F.lit(1).alias(c) for c in ("node", "start", "path", "own", "loss", "k", "part")])
    got = {r.conv_id: r for r in chat_format.read_back(extra).collect()}
    assert [len(got[i].turns) for i in (1, 2, 3, 4, None, 5)] == [2, 1, 1, 1, 1, 300] and got[4].turns[0].text == LONG
    assert got[5].loss_text == "".join(f"turn {k}" for k in range(0, 300, 2)) and got[3].loss_text == ""
    assert chat_format.prefix_tree(conv.limit(0)).count() == 0


def test_chat_loss_interval_is_the_text_alone(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", r"a \### b </turn> c"), (2, 0, "user", "q"), (2, 1, "assistant", "z")]
    nodes = chat_format.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("start").collect()
    stream = "".join(n.segment for n in nodes)
    assert sorted(stream[n.loss.start : n.loss.stop] for n in nodes if n.loss) == sorted([r"a \\\### b \</turn> c", "z"])
    assert len(nodes) == 3 and all(n.in_loss == (n.loss is not None) for n in nodes)


def test_html_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", f"<article><p>{LONG}</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"))
    got = html_extract.extract(pages).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 0, len(LONG)]


def test_long_unit_takes_linear_time():
    """A text without a space, ten times as long: the library's ids, and about ten times the time."""
    vocabulary = piece_codec.Vocabulary(piece_codec.pieces_of(MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    took = []
    for n in (40_000, 400_000):
        text = ("thequickbrownfoxjumpsoverthelazydogzzqxjk" * (n // 41 + 1))[:n]
        vocabulary.fits.clear()
        began = time.process_time()
        ids = vocabulary.encode(text)
        took.append(time.process_time() - began)
        assert list(memoryview(ids).cast("i")) == library.encode(text)
    assert took[1] < 40 * max(took[0], 0.02)


def test_ties(spark):
    """Equal code lengths go to the first language, equal intervals to one label."""
    docs = spark.createDataFrame([(1, "same words here"), (2, "same words here")], "doc_id long, text string")
    learned = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "xx").otherwise("aa"))
    assert {r.lang_pred for r in language_id.identify(docs, learned).collect()} == {"aa"}
    both = spark.createDataFrame([(1, "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed")], "doc_id long, text string")
    assert license_scan.scan(both).first().labels == "gpl"


@pytest.mark.parametrize("block", [3, 1])
def test_decontamination_in_blocks(spark, tables, monkeypatch, block):
    docs, items, _ = tables
    more = items.unionByName(spark.createDataFrame([(9, "456"), (10, "plain word")], "item_id long, text string"))
    whole = sorted(map(repr, decontamination.scan(docs, more).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 100 // block)
    assert sorted(map(repr, decontamination.scan(docs, more).collect())) == whole
