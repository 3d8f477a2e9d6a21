"""Operators 1, 2, 5, 7 and 8 against brute-force versions."""

import base64
import hashlib
import random
import re
from collections import Counter
from re import _parser as parser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from corpora import corpus
from pyspark.sql import functions as F
from tidemill.llm import common as C
from tidemill.llm import language_id, license_scan, queries, quality_rules
from tidemill.llm.decontamination import clean, digest, scan
from tidemill.llm.piece_codec import encode_decode

ASCII = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decontamination(spark):
    rows = corpus(7, 120)
    items = [(i, t) for i, t in corpus(7, 40)[4:]] + [(900, None), (901, ""), (902, "x"), (903, "Changed für")]
    got = {r.doc_id: r for r in digest(scan(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    windows = {}
    for i, t in items:
        w = ASCII.findall((t or "").translate(LOWER))
        for s in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    assert len(got) == len(rows)
    for i, t in rows:
        w = ASCII.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    kept = {r.doc_id for r in clean(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, r in got.items() if not r.contaminated}


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = digest(scan(frame(spark, [(1, "a b"), (2, None)]), none)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 2, 0, False), (2, 0, 0, False)]
    assert digest(scan(frame(spark, []), none)).count() == 0


def test_compression_bands(spark):
    rows = corpus(8, 150, 200)
    got = {r.doc_id: r for r in quality_rules.compression_bands(frame(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = SPLIT.findall(t)
        count = Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        again = set()
        for s in range(len(w) - 7):
            if count[tuple(w[s : s + 8])] > 1:
                again.update(range(s, s + 8))
        lines = [x for x in t.split("\n") if SPLIT.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.compression_bands(frame(spark, [])).count() == 0


def test_compression_bands_verdicts(spark, sf_dir):
    text = "".join(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars between 2000 and 6000").limit(3).collect())[:6000]
    noise = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(90))
    loop = " ".join(f"{w} again" for w in ["one", "two", "three"] * 300)
    got = {r.doc_id: r.band for r in quality_rules.compression_bands(frame(spark, [(1, text), (2, loop), (3, noise)])).collect()}
    assert got == {1: "inside", 2: "repetitive", 3: "incompressible"}


def test_ratios_and_bands_against_plain_zstandard(spark, sf_dir):
    """Ratio, chunk counts, band and kept of whole texts, computed text by text from the library and the tables of limits."""
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 300").limit(60).collect()] + ["", "x" * 9000, "ab " * 3000, rng.randbytes(4500).hex(), "é" * 5000, "word " * 40]
    squeeze, strong = zstandard.ZstdCompressor(level=quality_rules.LEVEL), zstandard.ZstdCompressor(level=quality_rules.STRONG)

    def limits(n):
        return [x for x in quality_rules.BANDS if n >= x[0]][-1][1:]

    def is_noise(piece):
        own = [x for x in quality_rules.MIXED if len(piece) >= x[0]]
        size = len(squeeze.compress(piece))
        if not own or size <= own[-1][2] * len(piece):
            return False
        order = np.argsort(C.spread(np.arange(1, len(piece) + 1, dtype=C.U)))
        mixed = bytes(piece[i] for i in order)
        return size > quality_rules.SUSPECT * len(squeeze.compress(mixed)) and len(strong.compress(piece)) > own[-1][1] * len(strong.compress(mixed))

    rows = {r.doc_id: r for r in quality_rules.compression_bands(frame(spark, list(enumerate(texts)))).collect()}
    bands = set()
    for i, text in enumerate(texts):
        data, r = text.encode(), rows[i]
        pieces = [data[k : k + quality_rules.CHUNK] for k in range(0, len(data), quality_rules.CHUNK)]
        shares = [len(squeeze.compress(p)) / len(p) for p in pieces]
        low = sum(s < limits(len(p))[0] for s, p in zip(shares, pieces, strict=True))
        high = sum(s > limits(len(p))[1] or is_noise(p) for s, p in zip(shares, pieces, strict=True))
        ratio = len(squeeze.compress(data)) / len(data) if data else 1.0
        assert (r.n_bytes, r.n_chunks, r.n_low_chunks, r.n_high_chunks) == (len(data), len(pieces), low, high) and r.ratio == pytest.approx(ratio)
        if low + high > quality_rules.BAD_CHUNKS * len(pieces) or high > quality_rules.NOISE_CHUNKS * len(pieces):
            band = "repetitive" if low >= high else "incompressible"
        elif ratio < limits(len(data))[0]:
            band = "repetitive"
        else:
            band = "incompressible" if ratio > limits(len(data))[1] or is_noise(data) else "inside"
        bands.add(band)
        assert r.band == band and r.kept == (not r.base_failed and band == "inside")
    assert bands == {"inside", "repetitive", "incompressible"}


@pytest.mark.parametrize("size", [900, 2000, 4096, 20000])
def test_noise_is_incompressible(spark, sf_dir, size):
    rng = random.Random(size)
    noise = [rng.randbytes(size).hex()[:size], base64.b64encode(rng.randbytes(size)).decode()[:size], "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))]
    prose = "\n".join(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars between 2000 and 6000").limit(8).collect())[:20000]
    rows = [*enumerate(noise), (3, prose[:size]), (4, prose[:15000] + noise[0][:4096] * (size == 4096))]
    got = {r.doc_id: r.band for r in quality_rules.compression_bands(frame(spark, rows)).collect()}
    assert got == {0: "incompressible" if size >= 1500 else "inside", 1: "incompressible", 2: "incompressible", 3: "inside", 4: "incompressible" if size == 4096 else "inside"}


def test_piece_codec(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  two  spaces ", "\n\nx\n", "日本語テスト 漢字", "emoji 🙂🙃 ​﻿", "a" * 300, "▁▁ x▁", "<s> </s> <unk>", "\t\ttab", "ﬁ ½ é é", " " * 50, "0123456789" * 5, "\x00\x01 ctl"]
    rows = corpus(9, 60) + [(1000 + i, t) for i, t in enumerate(odd)]
    rows += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for r in encode_decode(frame(spark, rows), path).collect():
        want = library.encode(dict(rows)[r.doc_id] or "")
        assert list(r.ids) == want, r.doc_id
        assert r.decoded == library.decode(want), r.doc_id


def test_license_scan_base(spark):
    phrases = ["MIT License", "Apache License, Version 2.0", "GNU General Public License v3", "general\npublic license", "mit-license", "licensed under the MIT license"]
    rows = [(i, (t or "") + " " + phrases[i % 6] + " " + (t or "")[:50] + (" " + phrases[i % 5] if i % 3 == 0 else "")) for i, t in corpus(10, 60)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    base = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, t in rows:
        w = ASCII.findall((t or "").translate(LOWER))
        at = [(s, label) for p, label in base.items() for s in range(len(w)) if tuple(w[s : s + len(p)]) == p]
        r = got[i]
        starts = [s for s, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def test_license_rules(spark):
    rows = [
        (1, "This is released under the Apache License, Version 2.0."),
        (2, "SPDX-License-Identifier: BSD-3-Clause"),
        (3, "See https://www.gnu.org/licenses/gpl-3.0 for the text; GNU General Public License, version 3"),
        (4, "no words of interest here"),
        (5, "GNU Lesser General Public License v2.1 and the Creative Commons Attribution license"),
    ]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == ["apache", "apache-2.0"] and got[2] == ["bsd-3-clause"] and got[4] == [""]
    assert "gpl-3.0" in got[3] and "gpl" in got[3]
    assert "lgpl-2.1" in got[5] and "lgpl" not in got[5] and "creative-commons" in got[5]
    assert len(license_scan.rules()) > 200


def test_license_names_alone(spark):
    alone = {
        "X11 License": "mit", "Expat license": "mit", "ASL 2.0": "apache-2.0", "Creative Commons Zero": "cc0-1.0", "PSF license": "psf-2.0",
        "do what the fuck you want to public license": "wtfpl", "https://joinup.ec.europa.eu/collection/eupl": "eupl-1.2",
    }
    far = " ".join(["word"] * 200)
    rows = [(i, f"{far} {x} {far}") for i, x in enumerate(alone)] + [(100 + i, f"{far} {x} {far} all rights reserved") for i, x in enumerate(alone)]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(frame(spark, rows)).collect()}
    for i, label in enumerate(alone.values()):
        assert got[i] == [label] and got[100 + i] == sorted(["all-rights-reserved", label])


def test_license_detections_of_whole_texts(spark):
    long = "creative commons " + "x" * 450 + " license"
    rows = [
        (1, "GPL v3 here, and GPLv2 there"), (2, "word " * 5000 + "under the Boost  Software\nLicense 1.0 " + "word " * 5000 + "WTFPL"), (3, long),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (5, "licensed under the GNU Lesser General Public License version 2.1"), (6, None), (7, ""),
    ]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == ["gpl-2.0", "gpl-3.0"] and got[2] == ["bsl-1.0", "wtfpl"] and got[4] == ["mit"] and got[6] == got[7] == [""]
    assert got[3] == ["creative-commons"] and got[5] == ["gpl", "lgpl-2.1"]  # gpl is the base phrase


def example(tree, pick):
    """A string that the parsed pattern matches; branch number ``pick`` and as many repeats as are needed (odd picks: one more)."""
    out = ""
    for op, arg in tree:
        if op is parser.LITERAL:
            out += chr(arg)
        elif op is parser.IN:
            out += chr(arg[0][1] if arg[0][0] is parser.LITERAL else arg[0][1][0])
        elif op is parser.BRANCH:
            out += example(arg[1][pick // 2 % len(arg[1])], pick)
        elif op is parser.SUBPATTERN:
            out += example(arg[3], pick)
        elif op is parser.MAX_REPEAT:
            out += example(arg[2], pick) * max(arg[0], min(pick % 2, arg[1]))
    return out


def plain_survivors(found):
    """Detections by priority, then length, then place; what overlaps one that stays goes."""
    kept = []
    for d in sorted(found, key=lambda d: (d[1], d[2], d[0], d[3])):
        if not any(d[0] < k[4] and k[0] < d[4] for k in kept):
            kept.append(d)
    return kept


def test_license_detections_go_only_by_what_stays(spark):
    """The middle one of three is better than its neighbours or not; many random ones against the plain form."""
    rng = random.Random(3)
    cases = [[(0, -20, -30, "a", 30, 0.5), (5, -10, -10, "c", 15, 0.6), (20, -40, -20, "b", 40, 0.7)], [], [(0, -1, -5, "x", 5, 0.1), (5, -1, -5, "y", 10, 0.2)]]
    for _ in range(200):
        starts = [(rng.randrange(60), rng.randrange(1, 15)) for _ in range(rng.randrange(12))]
        cases.append([(a, -rng.choice([10, 20, 30]), -n, f"l{a}", a + n, float(rng.randrange(1, 9)) / 10) for a, n in starts])
    kind = "start int, order int, size int, label string, stop int, weight double"
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, d array<struct<{kind}>>")
    got = {r.i: (sorted(r.s.labels), r.s.weight) for r in rows.select("i", license_scan.surviving(F.col("d")).alias("s")).collect()}
    for i, c in enumerate(cases):
        kept = plain_survivors(c)
        assert got[i] == (sorted({d[3] for d in kept}), max((d[5] for d in kept), default=0.0))
    assert got[0] == (["b", "c"], 0.7)


def test_license_rules_hold_their_keywords():
    for label, keyword, pattern, _, _ in license_scan.rules():
        for pick in range(14):
            text = example(parser.parse(pattern), pick)
            assert re.search(pattern, text), (label, text)
            near = re.sub(r"\s+", " ", text)
            assert keyword in near, (label, keyword, text)


def test_language_id(spark, sf_dir):
    got = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.9
    odd = frame(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "the of and that")])
    rows = {r.doc_id: r for r in language_id.identify(odd, language_id.learning_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    nothing = language_id.identify(odd, spark.createDataFrame([], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_scorer_equals_its_trees_when_slots_collide(monkeypatch):
    monkeypatch.setattr(language_id, "SLOTS", 6)
    batches = [pa.record_batch({"text": [t for _, t in corpus(seed, 60)]}) for seed in (21, 22, 23)]
    trees = []
    for b in batches[:2]:
        raw, at = C.strings(b.column("text"))
        code, parts = language_id.codes(raw, at), []
        for width in range(1, language_id.ORDER + 2):
            gram, n = np.unique(code & np.uint64((1 << (8 * width)) - 1), return_counts=True)
            parts.append((np.full(len(gram), width), gram.astype(np.int64), n))
        trees.append(language_id.Tree(*map(np.concatenate, zip(*parts, strict=True))))
    scorer = language_id.Scorer(["a", "b"], trees)
    for b in [*batches, *batches]:
        raw, at = C.strings(b.column("text"))
        code = language_id.codes(raw, at)
        want = [[t.bits(code[i:j]).sum() for i, j in zip(at[:-1], at[1:], strict=True)] for t in trees]
        assert np.allclose(scorer.lengths(raw, at), want, rtol=1e-4)
