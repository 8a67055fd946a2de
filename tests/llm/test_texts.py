"""Per-text operators: tokenizers against their libraries, models against their definitions, extraction and scans against plain code."""

import html
import math
import random
import re
import shutil
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hanloom.llm import bpe, html_extract, langid, licenses, lm_score, token_counts
from hanloom.llm.common import Workspace

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'s", "'re", " ", "\n", "\x1c", "\x85", "\xa0", "​", "　", "Σ", "ς", "İ", "ß", "é", "é", "中", "文", "½", "a", "B", "zz", "<|endoftext|>", "<|startoftext|>", "<|", "!", "!!", "🙂", "ﬁ", "\x00", "'", "K", "ẞ", "²", "_", "▁", "  ", "<s>", "</s>", "<0x0A>", "2", "42"]


def texts(n=60):
    rng = random.Random(n)
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:n] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", "a" * 3000, "!" * 900]


def test_bpe_as_library(spark):
    tk = Tokenizer.from_file(WORD)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(-1, None, None), (0, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lexicon = bpe.compile_lexicon(df, WORD, Workspace(spark, "test"), share=1e-4)
    out = bpe.encode(df, WORD, lexicon).withColumn("list", bpe.unpack_ids(F.col("ids"))).collect()
    want = {(i, t): tk.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        ids = want[r.doc_id, r.text]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids == r["list"] and r.decoded == tk.decode(ids, skip_special_tokens=False)
    none = df.limit(0)
    assert bpe.encode(none, WORD, bpe.compile_lexicon(none, WORD, Workspace(spark, "test"))).count() == 0


def test_lexicon_is_minimal():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(sorted({"tap", "taps", "top", "tops", "stop", "stops", "é", "a"}))}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words))
    listed = [*words, b"ta", b"", b"tapsx", b"zz"]
    got = lexicon.numbers(listed)
    assert [lexicon.ids_of(n).tolist() if n >= 0 else None for n in got] == [words.get(w) for w in listed]
    rest = {b"": frozenset()}

    def language(prefix):
        return frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))

    rest = {language(w[:k]) for w in words for k in range(len(w) + 1)}
    assert len(lexicon.final) == len(rest)
    assert bpe.Lexicon(bpe.Lexicon.compile({})).numbers([b"a"]).tolist() == [-1]


def test_merges_agree():
    model = bpe.WordBpe(open(WORD, "rb").read())
    words = [w.encode() for t in texts(5) for w in model.pieces(t) if not isinstance(w, int)]
    ids, at = model.merge_all(words)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model.merge(w) for w in words] and len(model.merge_all([])[0]) == 0


def test_every_code_point():
    tk, source = Tokenizer.from_file(WORD), open(WORD, "rb").read()
    model = bpe.WordBpe(source, bpe.unlike())
    encoder = bpe.Encoder(model, bpe.Lexicon(bpe.Lexicon.compile({})))
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    odd = [c for c in every if model.odd[ord(c)]]
    assert not any(map(bpe._PLAIN.fullmatch, odd)) and len(odd) > 1000
    known = [c for c in every if not model.odd[ord(c)]]
    plain = [c for c in known if ord(c) < 0x3400 or 0xF900 <= ord(c) < 0x10000 or 0x10000 <= ord(c) < 0x18000 or 0x1B000 <= ord(c) < 0x20000] + known[40_000::53]
    # Several to a text, apart, since each is a word or joins its neighbours alike.
    for make in (lambda c: f"{c} ", lambda c: f"a{c}b {c}1", lambda c: f"E{c}\u0301 x\u0327{c}"):
        some = ["".join(map(make, plain[i : i + 40])) for i in range(0, len(plain), 40)]
        got = encoder.encode(some)[0]
        for t, x, want in zip(some, got, tk.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(x, "<u4").tolist() == want.ids, t
    mixed = ["Əli Ɓ Ɖ Ɛ Ɔ Ɣ Ʊ Ⱥ", *(f"an {c}{c} a{c}" for c in odd[::2000] + [c for c in odd if ord(c) < 0x3000])]
    ids, said = encoder.encode(mixed)
    for t, x, y in zip(mixed, ids, said, strict=True):
        want = tk.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(x, "<u4").tolist() == want and y == tk.decode(want, skip_special_tokens=False)


def test_token_counts(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(-1, None, 2), (0, "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")

    def counts(frame):
        return sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame, PIECE, cache, limit=100).collect())

    want = sorted((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, _ in rows)
    assert counts(df.limit(500)) == sorted((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t, _ in rows[:500])
    assert counts(df) == want
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("content").distinct().count() == len({t or "" for _, t, _ in rows})
    assert counts(df) == want and spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows})
    assert counts(df.limit(0)) == []


def test_language_models():
    model = langid.fit(["abcab abd", "bac cab"], 5, 3)
    seen = sorted({*"abcd", "\0"})
    for before in ("ab", "xx", "\0a", "\0\0", "b\0", "ca"):
        total = 0
        for c in [*seen, "x"]:
            codes = np.array([0 if ch == "\0" else ord(ch) for ch in before + c], np.uint64)
            h = [langid.hashes(codes, n)[-1:] for n in range(1, 4)]
            ctx = [None, *(langid.hashes(codes, n - 1)[-2:-1] for n in range(2, 4))]
            total += math.exp(langid.log_probability(model, h, ctx)[0])
        assert total == pytest.approx(1, abs=0.02)  # the unknown symbol stands for the rest of the alphabet


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df)
    out = langid.identify(df, model).select("row.lang", "lang_pred", "score", (langid.fold("row.doc_id") == 2).alias("held_out")).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2, "123 !?", "c"), (3, "is the thing and of the other in there " * 5_000, None), (3, "is the", "d"), (4, "zqxjkvb wqzxkj qqxz zxqj vvkq " * 30, "e")], "doc_id long, text string, lang_pred string")
    got = langid.identify(odd, model).select("row.doc_id", "row.text", "lang_pred", "score", "rejected").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in got[:3])
    assert got[3].lang_pred == "en" and not got[4].rejected and got[5].rejected
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == 2
    nothing = langid.train(df.limit(0))
    assert [r.lang_pred for r in langid.identify(odd, nothing).collect()] == ["und"] * 6
    assert langid.identify(odd.limit(0), model).count() == 0


def test_language_scores_do_not_depend_on_batches():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:30]
    models = {k: langid.fit(t[k::3], 60) for k in range(3)}
    models = {str(k): m for k, m in models.items()}
    one, n = langid.Identifier(models).losses(t)
    each = [langid.Identifier(models).losses([x])[0][0] for x in t]
    assert np.allclose(one, each, atol=1e-5) and (n > 0).all()


def plain_losses(docs, chosen):
    """Losses of all ``docs`` (id to words) under a bigram model that counts the ``chosen`` ones, in a vocabulary of all that are counted."""
    pairs, words, mass, kinds = {}, {}, {}, {}
    vocabulary = {w for i in docs if i in chosen[1] for w in docs[i]}
    for i in chosen[0]:
        for a, b in zip(["^", *docs[i]], docs[i]):
            kinds[a] = kinds.get(a, 0) + ((a, b) not in pairs)
            pairs[a, b], words[b], mass[a] = pairs.get((a, b), 0) + 1, words.get(b, 0) + 1, mass.get(a, 0) + 1
    size, d = sum(words.values()) + len(vocabulary) + 1, lm_score.DISCOUNT
    out = {}
    for i, own in docs.items():
        p = [max(pairs.get((a, b), 0) - d, 0) / mass.get(a, 1) + (d * kinds[a] / mass[a] if a in mass else 1) * (words.get(b, 0) + 1) / size for a, b in zip(["^", *own], own)]
        out[i] = -sum(map(math.log, p)) / max(1, len(own))
    return out


def check_losses(got, rows, targets, counted):
    docs = {k: re.findall(r"[^\W_]+", (r[1] or "").lower()) for k, r in enumerate(rows)}
    every = [k for k in docs if counted(rows[k])]
    target = plain_losses(docs, ([k for k in every if rows[k][0] in targets], every))
    background = plain_losses(docs, (every, every))
    want = sorted((str(rows[k][0]), len(docs[k]), target[k], background[k]) for k in docs)
    assert len(got) == len(rows)
    for r, w in zip(sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in got), want, strict=True):
        assert r[:2] == w[:2] and r[2:] == pytest.approx(w[2:], abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_lm_score(spark, monkeypatch, small):
    if small:  # many slices and buckets
        monkeypatch.setattr(lm_score, "BUCKET", 64)
        monkeypatch.setattr(lm_score, "SLICE", 1 << 10)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))), "k", i % 9 > 0) for i in range(80)]
    rows += [(100, None, "k", True), (101, "...", None, True), (3, "repeated id a b", "k", True), (None, "no id", "k", True), (102, "Tie TIE tie_tie", "k", False), (103, "long " * 30_000, "k", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, counted boolean")
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(0, 80, 3)] + [(6, 0, 0, "x"), (9, 1, 1, "x"), (12, 1, None, "x"), (15, None, 0, "x"), (None, 1, 0, "x"), (7, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    targets = {i for i in range(0, 80, 3) if i not in (6, 9, 15)}
    assert sorted(r.id for r in lm_score.good_ids(labels).collect()) == sorted(targets)
    got = lm_score.score(df, lm_score.good_ids(labels), Workspace(spark, "test")).select("row.doc_id", "n_tokens", "target_loss", "background_loss", "difference").collect()
    check_losses(got, rows, targets, lambda r: True)
    assert all(r.difference == r.target_loss - r.background_loss for r in got)
    got = lm_score.score(df, lm_score.good_ids(labels), Workspace(spark, "test"), counted_col="counted").select("row.doc_id", "n_tokens", "target_loss", "background_loss").collect()
    check_losses(got, rows, targets, lambda r: r[3])
    assert lm_score.score(df.limit(0), lm_score.good_ids(labels.limit(0)), Workspace(spark, "test")).count() == 0


def test_html(spark):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for h in pages:
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        assert html_extract.main_text(h) == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(p|/p|h1|/h1|br)>", " ", article))).split())
    page = """<head><title>T</title></head><body><div id="page-header">Site</div><nav>a<ul><li>x</nav><div class="cookie-notice">We use cookies</div><div class="content">
      <h1>Title</h1><p>The first paragraph is long enough to be a surge, for it holds many words &amp; says so.</p><p>Second&nbsp;one <b>bo</b>ld, and <a href=x>on</a>.</p></div>
      <div class="sidebar"><p>""" + "side " * 40 + '</p></div><section id="comments"><p>' + "said " * 40 + "</p></section><form><p>sign up</form><script>if (a<b) '</p>'</script><footer>f"
    assert html_extract.main_text(page) == "Title The first paragraph is long enough to be a surge, for it holds many words & says so. Second one bold, and on."
    for plain, want in (("", ""), ("only text", "only text"), ("<p>short", "short"), ("<", "<"), ("<!-- x", ""), ("<script>x", "")):
        assert html_extract.main_text(plain) == want
    df = spark.createDataFrame([(1, None, "a"), (1, "<p>x</p>", "b")], "page_id long, html string, text string")
    assert [(r.row.text, r.text) for r in html_extract.extract(df).collect()] == [("a", ""), ("b", "x")]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_licenses(spark):
    mit = ". ".join(licenses.SENTENCES[k] for k in ("mit_grant", "mit_notice")) + ".\n\nAn unknown sentence. " + ". ".join(licenses.SENTENCES[k].upper() for k in ("mit_as_is", "mit_liability")) + "."
    cases = {
        mit: ["MIT"], "abc\nReleased under the MIT License.\nxyz": ["MIT"], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"], "x. All rights reserved.": ["Proprietary"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"], "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "": [], "under the MIT License": [],
        ". ".join(licenses.SENTENCES[k] for k in ("bsd_source", "bsd_grant", "bsd_binary")): [], "Redistribution": [],
        ". ".join(licenses.SENTENCES[k].replace("*", "Some Body") for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")): ["BSD-3-Clause"],
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*cases, None])], "doc_id long, text string, licences string")
    got = licenses.scan(df).select("row.doc_id", "licences").collect()
    assert [[x.licence for x in r.licences] for r in sorted(got)] == [*cases.values(), []]
    text = "abc\nReleased under the MIT License.\nxyz"
    s = licenses.Scanner()
    ((_, a, b, k),) = s.sentences(text)
    assert k == "mit_short" and "MIT License" in text[a:b] and s.licences([]) == []
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    lines = ("Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.")
    for t in docs:
        if any(x in t.split("\n") for x in lines):
            assert s.licences(s.sentences(t))


def test_token_cache_by_tokenizer_and_twice(spark, tmp_path, monkeypatch):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, "a b", "y"), (None, "c", None), (None, "c", None), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    cache, other = str(tmp_path / "cache"), str(tmp_path / "other.model")
    shutil.copy(PIECE, other)
    with open(other, "ab") as f:
        f.write(b"\x9a\x7d\x01x")  # an unknown field: the same pieces, another digest
    for path in (PIECE, other):
        first = sorted(map(str, token_counts.count_tokens(df, path, cache).collect()))
        assert len(first) == len(rows)
    kept = spark.read.parquet(cache)
    assert kept.count() == 6 and kept.select("tokenizer").distinct().count() == 2
    spark.read.parquet(cache).coalesce(1).write.mode("append").parquet(cache)  # as two jobs at a time leave it
    assert sorted(map(str, token_counts.count_tokens(df, other, cache).collect())) == first
    monkeypatch.setattr(token_counts, "_KEPT", 8)
    counter, sp = token_counts.PieceCounter(open(PIECE, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert counter.by_word and counter.counts(texts()) == [len(sp.encode(t)) for t in texts()] and len(counter.words) <= 8 >= len(counter.words.old)


def test_lm_slice_in_bounded_memory():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1 << 20, 1 << 63, 100_000).astype("<u8"))
    place = np.minimum(rng.zipf(1.3, 1_000_000), len(keys)) - 1
    n = np.array([0, 400_000, 0, 600_000])
    packed = keys.tobytes(), lm_score.squeeze(place), n.astype("<i8").tobytes(), 8, (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    tracemalloc.start()
    own = lm_score._Slice(*packed)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    before = np.concatenate([[len(keys)], place[:399_999], [len(keys)], place[400_000:-1]])
    assert np.array_equal(own.before[own.pair], before) and np.array_equal(own.after[own.pair], place) and len(np.unique(own.before * (len(keys) + 1) + own.after.astype(np.int64))) == len(own.before)
    assert most < 45 * len(place), most


def test_lm_score_leaves_no_shuffles(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before, made = shuffled(), []
    for _ in range(2):  # the driver may happen to collect its garbage, hardly each time
        out = lm_score.score(docs, docs.where("doc_id % 3 = 0").select("doc_id"), Workspace(spark, "test"))
        for _ in range(40):
            if (left := sum(n for name, n in shuffled().items() if name not in before)) < 10_000:
                break
            time.sleep(0.25)
        made.append(left)
    assert max(made) < 10_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert out.count() == docs.count()


def test_lm_score_keeps_every_word_and_pair(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET", 1 << 16)
    many = " ".join(f"w{k}" for k in range(60_000))  # over 1 / 1e-5 tokens with the rest, so that single words used to go
    rows = [(1, "x y " * 45_000, True), (2, many, True), (3, "w7 w8", True), (4, "w8 w7", True), (5, "never seen", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, counted boolean")
    got = lm_score.score(df, df.where("doc_id = 2").select("doc_id"), Workspace(spark, "test"), counted_col="counted").select("row.doc_id", "n_tokens", "target_loss", "background_loss").collect()
    check_losses(got, rows, {2}, lambda r: r[2])


APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''
GPL = '''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Some Body, Inc. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.'''


@pytest.mark.parametrize(
    ("text", "licence", "sentences"),
    [
        ("# a file\n# SPDX-License-Identifier: MIT\nimport os\n", "MIT", 1), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0", 1), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only", 1),
        (APACHE, "Apache-2.0", 5), ("\n".join(f"# {x}".rstrip() for x in APACHE.split("\n")), "Apache-2.0", 5), ("/*\n" + "\n".join(f" * {x}" for x in APACHE.split("\n")) + "\n */", "Apache-2.0", 5),
        ("x.py - a program\n" + GPL, "GPL-3.0-or-later", 3), (GPL.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2"), "GPL-2.0-or-later", 3), (BSD, "BSD-3-Clause", 4), (MPL, "MPL-2.0", 1),
    ],
)
def test_standard_notices(text, licence, sentences):
    s = licenses.Scanner()
    found = s.sentences(text)
    assert [x[0] for x in s.licences(found)] == [licence] and len(found) == sentences


LONG = "This paragraph of the main text is long enough to be a surge, for it has many words in it and goes on for a while."


def test_html_articles_are_evidence():
    cards = "".join(f'<article><a href="/{k}">Teaser {k}</a></article>' for k in range(5))
    assert html_extract.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><section>{cards}</section></body>") == f"{LONG} {LONG}"
    assert html_extract.main_text(f"<body><div><p>{LONG}</p></div><article><h1>T</h1><p>By</p><p>x</p><p>{LONG}</p><p>{LONG}</p><p>End.</p></article></body>") == f"T By x {LONG} {LONG} End."


def test_html_adverts_and_states():
    assert html_extract.main_text(f"<p>{LONG}</p><div class=ad>x</div><p>Short last line.</p><footer>f</footer>") == f"{LONG} Short last line."
    assert html_extract.main_text(f"<p>{LONG}</p><div class=ad>x</div><h2>Head</h2><aside>y</aside><p>Short.</p><footer>f</footer><p>Site</p>") == f"{LONG} Head Short."
    for value in ("content has-sidebar", "post-content comments-open", "layout sidebar-right", "social-page"):
        assert html_extract.main_text(f'<body><div class="{value}"><p>{LONG}</p><p>End.</p></div><div class="ad-box">Buy</div></body>') == f"{LONG} End."
