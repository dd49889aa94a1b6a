"""Licences, tokens, decontamination, toxicity, extraction: against brute force, the library, held-out pages."""

import hashlib
import random
import re

import zlib

import numpy as np
import pytest

from chunkloom.llm import decontaminate, extract, licenses, pieces, toxicity
from chunkloom.llm.registry import model_path
from chunkloom.llm.words import encoded, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_words_and_shingles_match_plain_python():
    texts = ["a b c d e f", "", "x y", "The the THE", "ünï-cödé aberverylongwordindeedmorethansixteenbytes ok", "q", "1 2 3 4 5 1 2 3 4 5"]
    h, first = word_hashes([encoded(t) for t in texts])
    words = [WORD.findall(lower(t)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert all((a == b) == (x == y) for a, x in zip(flat, h, strict=True) for b, y in zip(flat, h, strict=True))
    s, begin = shingle_hashes(h, first)
    grams = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []) for w in words]
    assert np.diff(begin).tolist() == [len(g) for g in grams]
    flat = [g for gs in grams for g in gs]
    assert all((a == b) == (x == y) for a, x in zip(flat, s, strict=True) for b, y in zip(flat, s, strict=True))


def plain_licences(text):
    w = WORD.findall(lower(text or ""))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_places_match_brute_force():
    r = random.Random(3)
    bits = ["mit", "license", "MIT License", "apache license", "cc by", "cc", "by", "gnu general public license", "gnu", "word", "\n", ",", "é", "cc-by", "CC BY-NC 4.0"]
    for _ in range(300):
        text = " ".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert licenses.scan(text)[:5] == plain_licences(text)


def test_licence_expressions():
    assert licenses.parse_expression("MIT OR Apache-2.0 AND (GPL-2.0 WITH Classpath-exception-2.0)") == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert licenses.evaluate(["mit", "gpl-3.0", "or"]) and not licenses.evaluate(["mit", "gpl-3.0", "and"])
    assert licenses.parse_expression("and or") is None
    found = licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0+) blah\nGNU Lesser General Public License")
    assert found[5] == "gpl-2.0+,lgpl,mit" and found[7] == "mit gpl-2.0+ or" and found[8] is True
    assert licenses.scan(None)[:7] == (0, 0, None, None, "", "", 0.0)
    for line in ("see the LICENSE file", "NOASSERTION", "NONE", "the", "unknown-license", "(see LICENSE-2.0", "proprietary and confidential"):
        assert licenses.parse_expression(line) is None and licenses.scan(f"SPDX-License-Identifier: {line}")[5] == "", line
    for line, want in {"MIT see COPYING": "mit", "GPL-2.0-only WITH LLVM-exception OR the": "gpl-2.0-only", "LicenseRef-Own AND 0BSD": "0bsd,licenseref-own", "EPL-2.0.": "epl-2.0"}.items():
        assert licenses.scan(f"SPDX-License-Identifier: {line}")[5] == want, line


def test_licence_scan_of_awkward_rows(awkward, empty, awkward_rows):
    got = licenses.license_scan(awkward).collect()
    assert len(got) == len(awkward_rows)
    assert licenses.license_scan(empty).count() == 0


def test_tokens_equal_the_library(spark, awkward, empty, awkward_rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    enc = pieces.Encoder(model_path())
    r = random.Random(5)
    alphabet = "ab é\n\t ▁漢字🙂\x00.,;()\"'-_=<>/\\ nthe ingtion" + "  "
    texts = [r[1] or "" for r in awkward_rows] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(400)] + ["x" * 5000, " " * 100, "aaaa" * 40 + "." * 99]
    for t in texts:
        ids = enc.encode(t)
        assert ids == lib.encode(t), repr(t[:80])
        assert enc.decode(ids) == lib.decode(ids)
    got = {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in pieces.piece_digest(awkward, model_path()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(r[0], len(i := lib.encode(r[1] or "")), sha(",".join(map(str, i))), sha(lib.decode(i))) for r in awkward_rows}
    assert pieces.piece_digest(empty, model_path()).count() == 0
    ids = pieces.piece_ids(awkward, model_path())
    assert {(x.doc_id, x.text) for x in pieces.piece_texts(ids, model_path()).collect()} == {(r[0], r[1] or "") for r in awkward_rows}


def test_cuts_behind_superscripts_and_fractions_equal_the_library(spark):
    enc = pieces.Encoder(model_path())
    texts = ["km².", "an area of 5 km². And x³, ½. m²) ª. ①."] + [f"a{c}{d}" for c in "²³¹½¼¾ªº①Ⅳ" for d in ".,;:)(-'\"/"]
    assert [enc.encode(t) for t in texts] == [enc.library.encode(t) for t in texts]
    got = pieces.piece_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model_path()).collect()
    assert {(x.doc_id, x.n_tokens) for x in got} == {(i, len(enc.library.encode(t))) for i, t in enumerate(texts)}


def test_a_wrong_cut_is_noticed():
    enc = pieces.Encoder(model_path())
    enc.split = pieces.re.compile("[^²]+|²")  # cuts the piece '².'
    with pytest.raises(ValueError):
        enc.encode("km².")


def test_the_cache_turns_over_without_loss(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    enc = pieces.Encoder(model_path())
    text = " ".join(f"word{i % 17}" for i in range(300))
    assert enc.encode(text) == enc.library.encode(text)


def test_contained_items_match_brute_force(spark, awkward_rows):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 17, 40, 40, 80])] + [(10, None), (11, ""), (12, "..."), (3, "w1 w2")]
    docs = []
    for d in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        if d % 3:
            part = (r.choice(items)[1] or "").split()
            if d % 2 and part:
                part[r.randrange(len(part))] = "edited"
            words[10:10] = part
        docs.append((d, " ".join(words)))
    docs += [((r_[0] or 0) * 100 + 1000 + k, r_[1]) for k, r_ in enumerate(awkward_rows)] + [(None, "w1 w1")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contained_items(a, b).collect()}
    assert got == decontaminate.brute_force(docs, items) and got
    clean = decontaminate.decontaminate(a, b).collect()
    assert sorted((x.doc_id or -1, x.text or "") for x in clean) == sorted((d or -1, t or "") for d, t in docs if not any(d == x for x, _ in got))
    assert decontaminate.contained_items(a, b.limit(0)).count() == 0 and decontaminate.contained_items(a.limit(0), b).count() == 0


def test_item_blocks_cover_all(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    b = spark.createDataFrame([(i, f"only item{i} here now ok") for i in range(10)], "item_id long, text string")
    a = spark.createDataFrame([(i, f"x only item{i} here now ok y") for i in range(10)], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.contained_items(a, b).collect()} == {(i, i) for i in range(10)}
    assert decontaminate.decontaminate(a, b).count() == 0


def toxic_corpus(n, seed):
    r = random.Random(seed)
    bad, good = [f"bad{i}" for i in range(12)], [f"good{i}" for i in range(800)]
    rows = []
    for i in range(n):
        words = [r.choice(good) for _ in range(r.randint(5, 150))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(1, 8) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, awkward, empty):
    rows = toxic_corpus(1500, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 900] + [(1200, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].toxic, bool(y)) for i, _, y in rows if i >= 900]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= x.p_severe <= 1 and 0 <= x.p_pervasive <= 1 for x in got.values())
    # graded categories hardly occur without the first
    assert np.mean([x.p_severe for x in got.values() if not x.toxic]) < 0.05 < np.mean([x.p_severe for x in got.values() if x.toxic])
    kept = {x.doc_id for x in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, x in got.items() if not x.toxic}
    assert toxicity.toxicity(awkward, labels, 0.5).count() == awkward.count()
    assert {x.toxic for x in toxicity.toxicity(awkward, labels.limit(0)).collect()} == {False}
    assert toxicity.without_toxic(empty, labels).count() == 0
    assert toxicity.without_toxic(awkward, labels).columns == awkward.columns


def test_repeated_labels_and_texts_do_not_fill_the_sample(spark, monkeypatch):
    rows = toxic_corpus(900, 3)
    monkeypatch.setattr(toxicity, "SAMPLE", 400)
    labels = [(i, y) for i, _, y in rows if i < 700]
    one, zero = next(i for i, y in labels if y), next(i for i, y in labels if not y)
    plain = spark.createDataFrame(labels, "doc_id long, toxic int")
    repeated = spark.createDataFrame(labels + [(one, 1), (zero, 0)] * 1500 + [(one, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    again = docs.unionByName(docs.filter(f"doc_id < {one + 1}"))
    score = lambda d, y: sorted((x.doc_id, x.p_toxic) for x in toxicity.toxicity(d, y).dropDuplicates(["doc_id"]).collect())
    assert score(docs, plain) == score(docs, repeated) == score(again, repeated)


def test_the_chain_is_that_of_plain_logistic_models():
    """Newton steps on dense features, out-of-fold probabilities by hand."""
    rows = [(i, y, np.unique(np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64)), None) for i, t, y in toxic_corpus(400, 6)]
    rows = [(i, y, w, np.ones(len(w), np.int32)) for i, y, w, _ in rows]
    chain = toxicity.train(rows)
    n, at = len(rows), {t: k for k, t in enumerate(chain.terms.tolist())}
    x = np.zeros((n, len(at)))
    for i, (_, _, w, _) in enumerate(rows):
        x[i, [at[t] for t in w.tolist() if t in at]] = 1

    def fitted(x, y):
        x = np.column_stack([x, np.ones(len(x))])
        ridge, w = np.diag([toxicity.RIDGE] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        return w

    probability = lambda x, w: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    y = np.array([r[1] for r in rows], float)
    fold = (np.arange(n) * 2654435761 % 2**32) % toxicity.FOLDS
    out = np.zeros(n)
    for k in range(toxicity.FOLDS):
        out[fold == k] = probability(x, fitted(x[fold != k], y[fold != k]))[fold == k]
    first = probability(x, fitted(x, y))
    model = toxicity.Linear(len(at), 0)
    model.w = chain.weights[0]
    begin = np.concatenate([[0], np.cumsum(x.sum(axis=1))]).astype(int)
    cols = np.nonzero(x)[1]
    assert np.abs(model.proba(cols, begin, np.zeros((n, 0))) - first).max() < 0.02
    # the second link: trained on what the folds say, applied to what the first link says
    again = toxicity.Linear(len(at), 1).fit(cols, begin, out[:, None], y, np.arange(n))
    plain = fitted(np.column_stack([x, out]), y)
    assert np.abs(again.proba(cols, begin, first[:, None]) - probability(np.column_stack([x, first]), plain)).max() < 0.05


def test_later_links_of_the_chain_see_earlier_probabilities():
    rows = [(i, y, np.unique(np.array([hash(w) % 2**60 for w in t.split()], np.uint64)), np.ones(len(set(t.split())), np.int32)) for i, t, y in toxic_corpus(300, 2)]
    rows = [(i, y, w, np.ones(len(w), np.int32)) for i, y, w, _ in rows]
    chain = toxicity.train(rows)
    assert [len(w) for w in chain.weights] == [len(chain.terms) + 1 + k for k in range(3)]
    assert chain.weights[1][len(chain.terms)] > 0  # severe texts are toxic


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>x";</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p>First   para
graph, with <b>bold &lt;text&gt;</b>.<br>Next.<p>Second one is here, and long enough.<div class=advert>Buy now</div><p>Third &#233;, done.</article>
<section class="comments"><p>Nice post!</p></section><aside class=sidebar><a href=/>Related</a></aside><form><p>Search</p><input></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert extract.main_text(PAGE) == "Title & more\n\nFirst para graph, with bold <text>. Next.\n\nSecond one is here, and long enough.\n\nThird é, done."
    for odd in (None, "", "<", "<p", "</p></div>", "<!-- ", "<script>", "<a href='", "a < b", "<p>" * 3000):
        extract.main_text(odd)
    assert extract.main_text(None) == ""


def test_extraction_on_held_out_layouts():
    model, right, all_ = extract.field(), 0, 0
    for page, said in extract.labelled_pages(120, seed=77):
        blocks, labels = extract.blocks_with_labels(page, said)
        got = model.decode(blocks)
        right, all_ = right + sum(a == b for a, b in zip(got, labels, strict=True)), all_ + len(labels)
    assert right / all_ > 0.98


def test_viterbi_finds_the_best_path():
    import itertools

    model = extract.field()
    for page, said in extract.labelled_pages(20, seed=5):
        blocks = extract.leaf_blocks(page)[:9]
        e = [sum(model.w[model.names[x]] for x in f if x in model.names) for f in extract.features(blocks)]
        score = lambda p, e=e: sum(a * b for a, b in zip(p, e, strict=True)) + sum(model.trans[a, b] for a, b in itertools.pairwise(p))
        assert abs(score(model.decode(blocks)) - max(score(p) for p in itertools.product((0, 1), repeat=len(blocks)))) < 1e-9


def test_extraction_of_awkward_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "<article><p>" + "long words here. " * 20_000 + "</article>", "")]
    got = extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got)[0] == (0, 0) and len(got) == 5 and max(x.n_chars for x in got) > 300_000
    assert all(x.n_chars == len(x.text) for x in got)


def test_a_list_and_a_heap_as_agenda_merge_alike(monkeypatch):
    enc, r = pieces.Encoder(model_path()), random.Random(3)
    some = ["▁" + "".join(r.choice("etaoinshrdlu漢é.") for _ in range(r.randint(0, 60))) for _ in range(500)] + ["", "aaaa" * 11]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [enc.few_symbols(x) for x in some] == [enc.symbols(x) for x in some]
