"""The pipeline against its stages' brute-force versions."""

import hashlib

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_ngram_join import brute as classes
from test_scans import ASCII, LOWER
from test_substring_dedup import brute as stripped
from tidemill.llm import language_id


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = language_id.identify(docs, language_id.learning_rows(docs)).collect()
    texts = {r.doc_id: texts[r.doc_id] for r in known if r.lang_pred != "und" and r.bits_per_byte <= language_id.MAX_BITS}
    kept = {i for i, (c, _) in classes(sorted(texts.items())).items() if c == i}
    texts = {i: t for i, t in texts.items() if i in kept}
    texts = {i: w if gone else texts[i] for i, _, gone, w in stripped(sorted(texts.items()))}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = ASCII.findall(r.text.translate(LOWER))
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, min(len(w), 1)))}
    sizes = {len(w) for w in windows}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in texts.items():
        w = ASCII.findall(t.translate(LOWER))
        if not any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w))):
            ids = library.encode(t)
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
