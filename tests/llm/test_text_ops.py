"""Held-out accuracy, brute force and edges of quality, toxicity, language and personal data."""

import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairweave.llm import langid, pii, quality, sampling, toxicity

BIG = "/root/testdata/sf0.01"


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


# quality


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_weights(docs, labels).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert np.mean([r.selected for r in bad]) < 0.1 and np.mean([r.selected for r in good]) > 0.9


def test_quality_log_ratios_by_hand():
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    target[3], raw[3], raw[4] = 10, 10, 30
    r = quality.log_ratios(target, raw)
    assert r[3] > 0 > r[4] >= math.log(quality.FLOOR)
    assert (quality.log_ratios(np.zeros(quality.BUCKETS), raw) == 0).all()


def test_quality_edges(odd, none, labels):
    got = quality.quality_weights(odd, labels).collect()
    assert len(got) == 9 and all(r.log_weight == 0 for r in got if r.doc_id in (2, 3, 4))
    assert quality.quality_weights(none, labels).count() == 0
    assert quality.quality_weights(odd, labels.where("false")).where("selected").count() == 9
    kept = quality.keep_selected(odd, labels)
    assert kept.columns == odd.columns and quality.keep_selected(none, labels).count() == 0
    chosen = quality.quality_weights(odd, labels).where("selected").select("doc_id").collect()
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, chosen))


@pytest.mark.parametrize("k", [0, 1, 7, 333, 999, 1000, 2000])
def test_cut_is_exact(spark, k):
    rows = spark.range(1000).select("id", (F.floor(F.pow(F.col("id") % 97, F.lit(3))) / 7).alias("x"))
    want = {r.id for r in rows.orderBy(F.desc("x"), "id").limit(k).collect()}
    got = {r.id for r in rows.where(sampling.cut_at(rows, "x", "id", k, bins=8, leaf=16)).collect()}
    assert got == want


# toxicity


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(fold(r.doc_id, 3) == 1 for r in rows)
    hit = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.005


def scorer():
    return toxicity.Scorer({"lexicon": {"idiot": 5.0}, "scale": 1.0, "bias": -3.0})


def test_grammar():
    s = scorer()
    plain, aimed = s.raw("what an idiot today")[0], s.raw("you are an idiot today")[0]
    denied, said = s.raw("he is not an idiot today")[0], s.raw("she said idiot today")[0]
    assert denied < said < plain < aimed
    assert s.raw("i will kill you")[0] > 0 == s.raw("kill the lights")[0] == s.raw("idiots abound")[0]
    assert s.raw("An IDIOT. An idiot!") == (2 * s.raw("an idiot")[0], 2) and s.raw(None) == (0.0, 0)


def test_composition_adds_weights():
    a = toxicity.machine(1, {(0, "x"): (0, "y", 1.0)}, ("x", "y"))
    b = toxicity.machine(2, {(0, "y"): (1, "x", 2.0)}, ("x", "y"))
    n, arcs = toxicity.compose(a, b)
    assert n == 2 and arcs[(0, "x")] == (1, "x", 3.0) and arcs[(1, "x")] == (1, "y", 1.0)


def test_toxicity_edges(odd, none, labels):
    for table in (labels, labels.where("false")):
        got = toxicity.toxicity(odd, table).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert all(not r.held_out for r in got if r.doc_id is None)
        assert toxicity.toxicity(none, table).count() == 0


# language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(fold(r.doc_id, 5) == 0 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_language_edges(odd, none):
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0.0) for r in langid.language_id(odd).collect()}
    assert {(2, True, True), (3, True, True), (4, True, True)} <= got and all(not u for i, u, _ in got if i in (1, 5, 6, 7, None))
    assert langid.language_id(none).count() == 0
    nothing = langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_folded_table_is_exact():
    rows = [("a", *np.unique(langid.buckets(t), return_counts=True)) for t in ("aba cab", "abba")] + [("b", *np.unique(langid.buckets("xyz zyx"), return_counts=True))]
    model = langid.fit([(y, i, n.astype(float)) for y, i, n in rows])
    assert langid.predict_one(model, "abab")[0] == "a" and langid.predict_one(model, "zyzx")[0] == "b"


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 14 <= n(m.group()) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= n(m.group()) <= 15]
    return pii.in_order(out)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("aB1.2@-+ ()5%_9é,3", max_size=50), st.text("12.0 -+5", max_size=70)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_are_linear():
    assert pii.base_spans("a" * 300_000) == [] and pii.base_spans("1" * 300_000) == [] and pii.base_spans("@a" * 100_000) == []


def test_gradient():
    tagger = pii.Tagger(1)
    rng = np.random.default_rng(0)
    c, y = rng.integers(0, pii.N_CLASSES, (3, 7)), pii.tags_of([(1, 4, "ip")], 7)[None].repeat(3, 0)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.gradient(c, y)
    for k, v in tagger.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        old, e = v[at], 1e-3
        v[at] = old + e
        up = tagger.gradient(c, y)[0]
        v[at] = old - e
        down = tagger.gradient(c, y)[0]
        v[at] = old
        assert abs((up - down) / 2 / e - float(g[k][at])) < 2e-3


@pytest.fixture(scope="module")
def finder(docs):
    return pii.Finder(pii.fit_on(docs))


def test_tagger_adds_other_spellings(finder):
    for text, kind in (("call (017) 555-7713 now ok then", "phone"), ("card 4111.1111.1111.1111 is good for it", "card")):
        base, every = finder([text])[0]
        assert base == [] and [k for _, _, k in every] == [kind]
    for text in ("on 2020-01-01 12:00 it was 1234567 ok", "version 2.0.1 and 3,000,000 items", "no digits here at all"):
        assert finder([text])[0] == ([], [])


def test_spans_across_windows(finder):
    for shift in range(0, 140, 9):
        text = "lorem " * 20 + "x" * shift + " call (017) 555-7713 now " + "ipsum " * 30
        assert [text[a:b] for a, b, _ in finder([text])[0][1]] == ["(017) 555-7713"]


def test_reconciled():
    found = [(0, 10, "phone", 0.9), (5, 20, "phone", 0.95), (20, 25, "ip", 0.9), (30, 40, "card", 0.99)]
    assert pii.reconciled(found, [(38, 50, "email")]) == [(5, 20, "phone"), (20, 25, "ip")]


def test_pii_edges(odd, none):
    got = {r.doc_id: r for r in pii.find_spans(odd).collect()}
    assert got[None].n_email == 1 and got[None].n_ip == 1 and got[None].spans.startswith("email:17:23,ip:27:35")
    assert got[2].spans == got[3].spans == "" and pii.find_spans(none).count() == 0
    masked = {r.doc_id: r for r in pii.masked(odd).collect()}
    assert masked[None].text == "no id here, mail [EMAIL] or [IP]" and masked[None].n_chars == len(masked[None].text)
    assert masked[2].text is None and masked[2].n_chars is None and pii.masked(odd).columns == odd.columns and pii.masked(none).count() == 0
    assert pii.mask("ab cd", [(0, 4, "card"), (3, 5, "ip")]) == "[CARD]"
