"""Round trips, brute force and edges of segmentation, token counts, fingerprints, media and mixing."""

import hashlib
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from pairweave.llm import jpeg, mixing, phrases, segment, tokencount, unigram

TEXTS = ["", "a", "▁", "a▁b ▁ c", "日本語テキスト \x00\t\n", "  lead  and trail  ", "😀😀 é", "word.\nNext, word!!", "x" * 200, "it's (a) test. e.g. ... www.com"]


@pytest.fixture(scope="module")
def sampler():
    return segment.Sampler()


def all_paths(v, text):
    per = []
    for u in unigram.units(v, text):
        edges, found = unigram.lattice(v, u), []

        def go(e, ids, score, edges=edges, found=found, u=u):
            if e == 0:
                found.append((ids, score))
            for s, w, i in edges[e]:
                go(s, ((i,) if i != v.unknown else tuple(v.unknown_ids(u[s:e]))) + ids, score + w)

        go(len(u), (), 0.0)
        per.append(found)
    joint = [(sum((p[0] for p in c), ()), sum(p[1] for p in c)) for c in itertools.product(*per)]
    z = np.logaddexp.reduce([x[1] for x in joint])
    return {ids: math.exp(s - z) for ids, s in joint}


def test_round_trips(sampler):
    d = segment.Decoder()
    for text in TEXTS:
        got = sampler.sample(text, 3)
        assert [d.decode(x[0].tolist()) for x in got] == [text] * len(got)
        assert len({tuple(x[0].tolist()) for x in got}) == len(got)
    assert len(sampler.sample(None, 3)) == 1


@pytest.mark.parametrize("text", ["on a", "abc d"])
def test_samples_follow_the_lattice(sampler, text):
    p = all_paths(sampler.v, text)
    n, first, pair, weight = 4000, Counter(), Counter(), Counter()
    for s in range(n):
        got = [(tuple(x.tolist()), lp, q) for x, lp, q in sampler.sample(text, 7919 * s + 13)]
        first[got[0][0]] += 1
        pair[tuple(g[0] for g in got)] += 1
        for ids, lp, q in got:
            assert p[ids] == pytest.approx(math.exp(lp))
            weight[ids] += 1 / q
    for a in p:
        sd = math.sqrt(p[a] * (1 - p[a]) / n) + 1e-3
        assert abs(first[a] / n - p[a]) < 5 * sd
        for b in p:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert abs(pair[(a, b)] / n - want) < 5 * math.sqrt(want / n) + 2e-3
    top = max(p, key=p.get)
    assert weight[top] / n == pytest.approx(1, abs=0.05)  # inverse inclusion weights are unbiased


def test_all_paths_come_when_asked_for():
    s = segment.Sampler(k=50)
    p = all_paths(s.v, "in a")
    got = s.sample("in a", 1)
    assert {tuple(x[0].tolist()) for x in got} == set(p) and all(x[2] == 1.0 for x in got)


def test_tables_change_no_result():
    texts = ["the cat sat on the mat. the end\n" * 3, "another catalogue of mats"] * 4
    warm, cold = segment.Sampler(), [segment.Sampler().sample(t, i) for i, t in enumerate(texts)]
    for got, want in zip(warm.sample_all(texts, list(range(8))), cold, strict=True):
        assert [x[0].tolist() for x in got] == [x[0].tolist() for x in want]


def test_encode_decode(odd, none):
    back = segment.decode(segment.encode(odd, keep=("text",))).collect()
    assert len(back) == 9
    for r in back:
        if r.text is None:
            assert r.samples is None and r.texts is None
        else:
            assert set(r.texts) == {r.text} and 1 <= len(r.samples) <= 2
    twins = [r.samples for r in back if r.doc_id == 1]
    assert twins[0] == twins[1]
    assert segment.encode(none).count() == 0 and segment.decode(segment.encode(none)).count() == 0


def test_counts_equal_the_public_library(docs):
    c = unigram.Counter()
    order = sorted(c.v.pieces.items(), key=lambda x: x[1][0])
    tk = Tokenizer(models.Unigram([("<unk>", 0.0), *((p, s) for p, (_, s) in order)], unk_id=0, byte_fallback=False))
    known = set(c.v.pieces)
    texts = [r.text for r in docs.limit(40).collect()] + TEXTS
    for u in {u for t in texts for u in unigram.units(c.v, t)} - {unigram.LITERAL}:
        e = tk.encode(u)
        want = sum(1 if t in known else len(u[a:b].encode()) for t, (a, b) in zip(e.tokens, e.offsets, strict=True))
        assert unigram.viterbi(c.v, u)[1] == want, u


def test_viterbi_equals_all_paths():
    v = unigram.load()
    for u in ("▁the", "▁inin", "▁xqz", "abab"):
        best = max(math.fsum(w for w in ws) for ws in _scores(v, u))
        assert unigram.viterbi(v, u)[0] == pytest.approx(best)


def _scores(v, u):
    edges = unigram.lattice(v, u)

    def go(e):
        if e == 0:
            yield []
        for s, w, _ in edges[e]:
            for rest in go(s):
                yield [*rest, w]

    return go(len(u))


def test_count_edges(odd, none):
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(odd).collect()}
    assert got[2] == got[3] == 0 and got[1] == got[7] > 0 and got[5] >= 20000
    assert tokencount.token_counts(none).count() == 0


# fingerprints


def test_equal_parts_have_equal_phrases():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 8))) for _ in range(400)).encode()
    a, _ = phrases.parse([np.frombuffer(text, np.uint8)])
    b, _ = phrases.parse([np.frombuffer(b"some other words " + text[150:], np.uint8)])
    for x, y in list(zip(a, b, strict=True))[:3]:
        assert len(set(x[0].tolist()) & set(y[0].tolist())) > 0.75 * len(set(y[0].tolist()))


def test_batches_change_no_fingerprint(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["", "a", "aa", "aaaa" * 50, "ab" * 70, "é"]
    top, bins = phrases.fingerprints(texts)
    for i, t in enumerate(texts):
        alone = phrases.fingerprints([t])
        assert alone[0][0] == top[i] and (alone[1][0] == bins[i]).all()
    assert len(set(phrases.spelled(top, bins))) == len(set(texts))


def test_fingerprint_query_by_hand(docs):
    got = {r.doc_id: r for r in phrases.document_fingerprints(docs, ranges=9).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)][1], len(t) // 3
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest() and got[d].n_chars == len(t)
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.2 > np.mean([r.near_next for r in long])


def test_fingerprint_edges(spark, odd, none):
    assert phrases.document_fingerprints(odd).count() == 9 and phrases.document_fingerprints(none).count() == 0
    got = phrases.document_fingerprints(odd).collect()
    assert len({r.fingerprint for r in got if r.doc_id in (1, 7)}) == 1 and all(0 <= r.near_next <= 1 for r in got)
    one = phrases.document_fingerprints(spark.createDataFrame([(None, "abcabc")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcaab").hexdigest() and one.near_next == 1.0


# media


def test_jpeg_round_trip():
    payloads = [jpeg.payload_of(t)[0] for t in ("", "abc", "é" * 1000)] + [os.urandom(576 * 3), os.urandom(24 * 8192), bytes(range(256)) * 9]
    for p, (image, pixels) in zip(payloads, jpeg.thumbnails(jpeg.write(payloads)), strict=True):
        assert pixels.tobytes()[: len(p)] == p and image.comment == b"payload %d" % len(p)
        assert image.height <= 65535 and image.width <= 65535


def other_jpeg(width, height, sampling, restart, seed):
    """A baseline file with AC coefficients and several components, made symbol by symbol; and its luminance DC values."""
    rng = random.Random(seed)
    dc_len, ac = {i: 4 for i in range(12)}, [0x00, 0xF0, *[(r << 4) | s for r in range(3) for s in range(1, 4)]]
    dcs, acs = jpeg.canonical(dc_len), jpeg.canonical({s: 5 for s in ac})
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([16]) * 64)
    head += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += seg(0xC4, bytes([0, *dcs[0], *dcs[1]])) + seg(0xC4, bytes([16, *acs[0], *acs[1]]))
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    head += seg(0xDA, bytes([len(sampling), *[b for i in range(len(sampling)) for b in (i + 1, 0)], 0, 63, 0]))
    one = len(sampling) == 1
    hm, vm = (1, 1) if one else (max(h for h, _ in sampling), max(v for _, v in sampling))
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    bits, data, luma, last = "", b"", [], [0] * len(sampling)

    def flush():
        nonlocal bits, data
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        data, bits = data + raw.replace(b"\xff", b"\xff\0"), ""

    def value(x, n):
        return format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""

    for m in range(across * down):
        if restart and m and m % restart == 0:
            flush()
            data, last = data + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]), [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for _ in range(1 if one else h * v):
                dc = rng.randint(-60, 60)
                d, last[c] = dc - last[c], dc
                if c == 0:
                    luma.append(dc)
                n = abs(d).bit_length()
                bits += format(dcs[2][n], "04b") + value(d, n)
                k = 1
                while k < 64 and rng.random() < 0.6:
                    s = rng.choice(ac[1:])
                    run, size = s >> 4, s & 15
                    if k + run >= 64 or (s == 0xF0 and k + 16 >= 64):
                        break
                    bits += format(acs[2][s], "05b") + (value(rng.choice([1, -1]) * ((1 << size) - 1), size) if size else "")
                    k += run + 1
                if k < 64:
                    bits += format(acs[2][0], "05b")
    flush()
    h, v = (1, 1) if one else sampling[0]
    grid = np.array(luma).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return head + data + b"\xff\xd9", np.clip(grid * 2 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize(("sampling", "restart"), [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3), ([(1, 1), (1, 1), (1, 1)], 2)])
def test_reader_takes_any_baseline_file(sampling, restart):
    files = [other_jpeg(70, 45, sampling, restart, s) for s in range(3)] + [other_jpeg(16, 130, sampling, restart, 9)]
    for (_, want), (_, pixels) in zip(files, jpeg.thumbnails([f for f, _ in files]), strict=True):
        assert (pixels == want).all()


def test_reader_rejects_others():
    for bad in (b"", b"GIF89a", b"\xff\xd8\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            jpeg.thumbnails([bad])


def test_media_query(odd, none):
    got = {r.doc_id: r for r in jpeg.media_digests(jpeg.media_features(jpeg.stored(odd))).collect()}
    raw = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for d, r in got.items():
        p = raw[d] + b"\xff" * (-len(raw[d]) % 576 or (0 if raw[d] else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw[d]), len(p), hashlib.sha256(p).hexdigest())
    assert got[1].media_sha256 == got[7].media_sha256 and got[2].feature == got[3].feature
    assert jpeg.media_digests(jpeg.media_features(jpeg.stored(none))).count() == 0


# mixing


def fill(sizes, weights, total, most):
    """Targets by repeated resharing, as plain arithmetic."""
    capped, out = set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 5000]) + rng.randrange(9) for i in range(11)}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want)


def test_mix(docs):
    rows = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == round(own[0].target) and all(r.taken <= 2 * r.size for r in own)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    assert mix.select(F.sum(mixing.word_count())).first()[0] == sum(r.taken for r in rows)
    order = [r.position for r in mixing.mixed(docs).where("position is not null").collect()]
    assert order == sorted(order)


def test_positions_invert_the_demand(docs):
    rows = [r for r in mixing.mixed(docs).collect() if r.position is not None]
    assert min(r.position for r in rows) == 0.0 and max(r.position for r in rows) <= 1.0


def test_mixing_edges(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == 9 and all(r.taken == 0 and r.position is None for r in rows if r.size == 0)
    assert mixing.mixed(none).count() == 0 and mixing.mix_documents(none).count() == 0
    mix = mixing.mix_documents(odd)
    assert mix.columns == odd.columns and mix.count() > 0
    clash = odd.withColumns({c: F.lit(1) for c in ("taken", "position", "target", "source_size", "_s", "_start", "size", "rank")})
    assert mixing.mix_documents(clash).columns == clash.columns
    assert sorted(map(str, mixing.mix_documents(clash).select(odd.columns).collect())) == sorted(map(str, mix.collect()))
