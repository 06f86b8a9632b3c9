"""Whole queries against plain versions, and the edges of what they are built from."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from pairweave.llm import arrow, jpeg, langid, mixing, neardup, phrases, pii, quality, queries, sampling, segment, toxicity, unigram
from tests.llm.test_text_ops import plain
from tests.llm.test_tokens_media import TEXTS, other_jpeg

LETTERS = r"[^\W\d_]+(?:['’][^\W\d_]+)?"


# toxicity


def sum_of_clause(words, lexicon):
    """The five machines one behind the other, not composed."""
    classes = toxicity._classes() | {w: toxicity.insult_class(x) for w, x in lexicon.items()}
    symbols, total = [classes.get(w, "other") for w in words], 0.0
    for _, arcs in toxicity.machines():
        state, out = 0, []
        for x in symbols:
            state, y, w = arcs[(state, x)]
            out.append(y)
            total += w
        symbols = out
    return total if {"insult", "denied", "threat"} & set(symbols) else 0.0


def plain_raw(text, lexicon):
    sums = [sum_of_clause(re.findall(LETTERS, c), lexicon) for c in re.split(r"[.!?;:\n]", (text or "").lower())]
    return sum(x for x in sums if x > 0), sum(x > 0 for x in sums)


def test_toxicity_query_equals_machines_in_turn(spark, odd):
    words = ["you", "fool", "moron", "not", "said", "will", "kill", "the", "he", "never", "hat", "tree"]
    rng = random.Random(3)
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) + rng.choice([".", "!", "; no", "\nx"])) for i in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([*rows, (999, "KILL " * 30000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int("fool" in t or "moron" in t)) for i, t in rows if i % 2], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    assert {"fool", "moron"} & set(model["lexicon"])
    got = {(r.doc_id, r.score, r.predicted, r.n_clauses) for r in toxicity.toxicity(docs, labels).collect()}
    want = set()
    for r in docs.collect():
        raw, n = plain_raw(r.text, model["lexicon"])
        score = 1 / (1 + math.exp(-(model["scale"] * raw + model["bias"])))
        want.add((r.doc_id, score, int(score >= 0.7), n))
    assert {(i, round(s, 9), p, n) for i, s, p, n in got} == {(i, round(s, 9), p, n) for i, s, p, n in want}


def test_lexicon_equals_plain_counts(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for _ in range(500):
        toxic = rng.random() < 0.4
        text = [rng.choice(words) for _ in range(30)] + ([rng.choice(["vile", "foul"])] if toxic and rng.random() < 0.7 else [])
        rng.shuffle(text)
        rows.append((" ".join(text), int(toxic)))
    rows += [("copied slur here", 1)] * 50  # one context, however often
    got = toxicity._lexicon(spark.createDataFrame(rows, "text string, toxic int"), sum(not y for _, y in rows), sum(y for _, y in rows))
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    want = {}
    for w in {w for t, _ in rows for w in t.split()}:
        tox, clean = (sum(w in t.split() for t, y in rows if y == k) for k in (1, 0))
        near = {(["", *t.split(), ""][i - 1], ["", *t.split(), ""][i + 1]) for t, y in rows if y for i, x in enumerate(["", *t.split(), ""]) if x == w}
        odds = toxicity.odds_of(min(tox, len(near)), clean, n[1], n[0])
        if odds is not None:
            want[w] = odds
    assert got == pytest.approx(want) and set(got) == {"vile", "foul"}


def test_very_strong_scores_are_not_tied():
    s = toxicity.Scorer({"lexicon": {"idiot": 5.0}, "scale": 0.1, "bias": -3.0})
    assert s.score("you idiot. " * 12)[0] < s.score("you idiot. " * 20)[0] < 1


# fingerprints


def plain_parse(data, levels):
    """Names of the phrases of every level, one symbol after the other."""
    mask = (1 << 64) - 1

    def mixed(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * c) & mask
        return x ^ (x >> 33)

    def toss(left, own):
        if left == own:
            return own & 1
        at = ((left ^ own) & -(left ^ own)).bit_length() - 1
        return 2 * at + ((own >> at) & 1)

    def tossed(labels):
        return [toss(labels[i - 1] if i else labels[0] ^ 1, x) for i, x in enumerate(labels)]

    small, names, out = list(data), [int(phrases._NAMES[b]) for b in data], []
    for level in range(1, levels + 1):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(range(len(names)), key=lambda i: names[i])]
        first, at = [], 0
        for _, n in runs:
            first.append(at)
            at += n
        symbols = [k for k, _ in runs]
        labels = tossed([small[i] for i in first]) if level == 1 else tossed(tossed(symbols))
        labels = tossed(tossed(labels))
        symbols = [mixed((k + n * 0xD6E8FEB86659FD93) & mask) if n > 1 else k for k, n in runs]
        n = len(labels)
        top = [i == 0 or (i > 1 and labels[i] > labels[i - 1] and (i + 1 == n or labels[i] > labels[i + 1])) for i in range(n)]
        starts = [i for i in range(n) if top[i]]
        names = []
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            names.append(mixed(sum(mixed((symbols[i] + (i - a) * 0x9E3779B97F4A7C15) & mask) for i in range(a, b)) & mask))
        out.append(names)
    return out


def test_parser_equals_a_plain_one(docs):
    texts = [r.text.encode() for r in docs.limit(12).collect() if r.text] + [b"a", b"aaaa", b"abab" * 30, bytes(range(256)) * 2, "é😀 é".encode()]
    parsed, _ = phrases.parse([np.frombuffer(t, np.uint8) for t in texts])
    for level, (names, first) in enumerate(parsed):
        cuts = [*first.tolist(), len(names)]
        for i, t in enumerate(texts):
            assert names[cuts[i] : cuts[i + 1]].tolist() == plain_parse(t, level + 1)[level], (level, t[:20])


def spelled_likeness(a, b):
    cut = lambda s: [s.split(":")[1][i : i + 4] for i in range(0, 4 * phrases.BINS, 4)]
    x, y = cut(a), cut(b)
    used = [(p, q) for p, q in zip(x, y, strict=True) if p != "----" or q != "----"]
    return sum(p == q for p, q in used) / len(used) if used else 1.0


def test_likeness_follows_from_the_spelled_fingerprints(docs, odd):
    for table in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(phrases.document_fingerprints(table, ranges=5).collect(), key=lambda r: -r.doc_id)
        for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
            assert r.near_edited == spelled_likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == spelled_likeness(r.fingerprint, after.fingerprint)


def test_ranges_are_found_by_halving(spark):
    edges = [3, 10, 11, 400]
    got = spark.range(420).withColumnRenamed("id", "doc_id").select("doc_id", phrases._range_of(edges, 0, 4).alias("n")).collect()
    assert all(r.n == sum(b < r.doc_id for b in edges) for r in got)


# media


def test_media_query_by_hand(spark, odd, sf):
    for table in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted(map(tuple, jpeg.media_digests(jpeg.media_features(jpeg.stored(table))).collect()), key=str)
        want = []
        for r in table.collect():
            raw = (r.text or "").encode()
            p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            m = jpeg.write([p])[0]
            image, pixels = jpeg.thumbnails([m])[0]
            feature = f"{image.width}x{image.height}:{pixels.shape[1]}x{pixels.shape[0]}:{jpeg.thumbnail_hash(pixels)}"
            want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        assert got == sorted(want, key=str)


def test_long_payloads_are_several_files(monkeypatch):
    monkeypatch.setattr(jpeg, "CHUNK", 5000)
    payloads = [bytes(range(256)) * n for n in (1, 40, 80)] + [b"x" * 5000, b"y" * 5001]
    media = jpeg.media_of(payloads)
    assert [len(jpeg.images_of(m)) for m in media] == [1, 3, 5, 1, 2]
    read = jpeg.read_all(media)
    assert [p for p, _, _ in read] == payloads and [f.count("+") for _, f, _ in read] == [0, 2, 4, 0, 1]


def test_broken_media_are_values(spark):
    good = jpeg.write([b"abc" * 200])[0]
    bad = [None, b"", b"GIF89a", b"\xff\xd8\xff\xd9", good[:-40], good[: len(good) // 2], good.replace(b"\xff\xc4", b"\xff\xe4"), good[:300] + b"\xff\xd9"]
    for cut in range(2, 200, 7):
        bad.append(good[:cut])
    noise = bytearray(good)
    noise[-200:-20] = bytes(180)
    rows = spark.createDataFrame([(i, m, "old", 7) for i, m in enumerate([good, *bad, bytes(noise), good])], "n int, media binary, feature string, payload int")
    got = {r.n: r for r in jpeg.media_features(rows).collect()}
    assert got[0].payload == got[len(bad) + 2].payload == b"abc" * 200 and got[0].error is None
    assert all(got[i].payload is None and got[i].feature is None and got[i].error for i in range(1, len(bad) + 1))
    assert got[1].error == "null" and rows.columns[0] in got[0] and got[0].feature != "old"
    digests = jpeg.media_digests(jpeg.media_features(rows).selectExpr("n as doc_id", "1L as n_bytes", "media", "payload", "feature")).collect()
    assert sum(r.payload_sha256 is None for r in digests) >= len(bad)


def scan_by_component(width, height, restart):
    """The luminance scan alone, then another component's: the same data as a file of one component, under a frame of three."""
    one, want = other_jpeg(width, height, [(1, 1)], restart, 5)
    frame = one.index(b"\xff\xc0")
    size = int.from_bytes(one[frame + 2 : frame + 4], "big")
    body = one[frame + 4 : frame + 2 + size]
    three = body[:5] + b"\x03" + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00"
    scan = one.index(b"\xff\xda")
    other = one[scan:-2].replace(b"\xff\xda\x00\x08\x01\x01", b"\xff\xda\x00\x08\x01\x02", 1)
    return one[:frame] + b"\xff\xc0" + (len(three) + 2).to_bytes(2, "big") + three + one[frame + 2 + size : -2] + other + b"\xff\xd9", want


@pytest.mark.parametrize("restart", [0, 2])
def test_reader_takes_scans_of_single_components(restart):
    data, want = scan_by_component(70, 45, restart)
    image, pixels = jpeg.thumbnails([data])[0]
    assert (pixels == want).all() and image.end == len(data)


# quality


def test_quality_query_equals_plain_counts(spark, sf, odd):
    for docs, labels in (
        (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")),
        (odd, spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")),
    ):
        rows, good = docs.select("doc_id", "text").collect(), {r.doc_id for r in labels.where("quality = 1").collect()}
        raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
        for r in rows:
            for b in quality.ngram_buckets(r.text).tolist():
                raw[b] += 1
                target[b] += r.doc_id in good
        ratio = quality.log_ratios(target, raw)
        got = quality.quality_weights(docs, labels).collect()
        weight = {r.doc_id: sum(ratio[b] for b in quality.ngram_buckets(r.text).tolist()) for r in rows}
        assert all(r.log_weight == pytest.approx(weight[r.doc_id], abs=1e-6) for r in got)
        k = sum(r.log_weight >= -quality.SLACK for r in got)
        ids = [r.doc_id for r in sorted(got, key=lambda r: (-r.perturbed, r.doc_id is None, r.doc_id or 0))[:k]]
        if len({r.doc_id for r in got}) == len(got):
            assert {r.doc_id for r in got if r.selected} == set(ids)


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where(sampling.remainder(2) == 0)
    rows = quality.quality_weights(docs, half).join(labels.where(sampling.remainder(2) == 1), "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(bad) > 100 and np.mean([r.selected for r in bad]) < 0.05 and np.mean([r.selected for r in good]) > 0.95


# personal data


def test_pii_query_equals_plain_patterns(spark, docs, odd):
    dense = [(1000 + i, "tel " + " ".join(str(j * 37 % 1000) for j in range(i * 50)) + " a@b.co 10.0.0.1 4111 1111 1111 1111") for i in range(6)]
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(dense, "doc_id long, text string"))
    tagger = pii.fit_on(table)
    got = sorted(map(tuple, pii.find_spans(table).collect()), key=str)
    want = []
    for r in table.collect():
        text = r.text or ""
        base = plain(text)
        found, every = pii.Finder(tagger)([r.text])[0]
        assert found == base and set(base) <= set(every)
        added = [s for s in every if s not in base]
        assert all(pii.plausible(k, text[a:b]) and all(b <= x or y <= a for x, y, _ in every if (x, y) != (a, b)) for a, b, k in added)
        count = [sum(s[2] == k for s in every) for k in pii.KINDS]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        want.append((r.doc_id, *count, digest, ",".join(f"{k}:{a}:{b}" for a, b, k in every)))
    assert got == sorted(want, key=str)


def best_subset(found, fixed):
    clear = {}
    for a, b, k, p in found:
        if all(b <= x or y <= a for x, y, _ in fixed):
            clear[(a, b, k)] = max(p, clear.get((a, b, k), 0))
    best = 0.0
    for n in range(len(clear) + 1):
        for some in itertools.combinations(sorted(clear), n):
            if all(x[1] <= y[0] for x, y in itertools.pairwise(some)):
                best = max(best, sum(clear[s] * (s[1] - s[0]) for s in some))
    return best, clear


def test_reconciled_equals_all_subsets():
    rng = random.Random(8)
    for _ in range(300):
        draw = lambda: (lambda a: (a, a + rng.randrange(1, 9)))(rng.randrange(30))
        found = [(*draw(), rng.choice(pii.KINDS), round(rng.random(), 2)) for _ in range(rng.randrange(9))]
        fixed = [(*draw(), "email") for _ in range(rng.randrange(3))]
        got = pii.reconciled(found, fixed)
        best, clear = best_subset(found, fixed)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(got)) and set(got) <= set(clear)
        assert sum(clear[s] * (s[1] - s[0]) for s in got) == pytest.approx(best)


def test_skipped_windows_hold_nothing():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("abc 12@.-") if rng.random() < 0.05 else rng.choice("xyz ") for _ in range(rng.randrange(400)))
        starts = set(pii.window_starts(pii.classes(text)).tolist())
        for s in range(0, len(text), pii.STRIDE):
            w = text[s : s + pii.WINDOW]
            assert (s in starts) == ("@" in w or sum(c.isdigit() for c in w) >= 4)


# language


def test_language_query_equals_embeddings(spark, sf, odd):
    signs = spark.createDataFrame([(500 + i, t, "en", "s", 1, 0.0, "k") for i, t in enumerate(["²", "½ ①", "_12", "x²", "ª"])], odd.schema)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").union(odd.union(signs).select("doc_id", "text", "lang"))
    model = langid.fit_on(table)
    got = {(r.doc_id, r.lang_pred, round(r.score, 9), r.held_out) for r in langid.language_id(table).collect()}
    want = set()
    for r in table.collect():
        lang, score = "und", 0.0
        if any(c.isalpha() for c in r.text or ""):
            z = np.mean([model["table"][b].astype(np.float64) for b in langid.buckets(r.text).tolist()], axis=0) / model["temperature"]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            lang, score = model["langs"][int(p.argmax())], float(p.max())
        want.add((r.doc_id, lang, round(score, 9), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0))
    assert {(i, x, h) for i, x, _, h in got} == {(i, x, h) for i, x, _, h in want}
    assert {(i, round(s, 6)) for i, _, s, _ in got} == {(i, round(s, 6)) for i, _, s, _ in want}
    assert {x for i, x, _, _ in got if i in (500, 501, 502)} == {"und"}


# token counts


def test_whole_documents_equal_the_public_library(docs):
    c = unigram.Counter()
    order = sorted(c.v.pieces.items(), key=lambda x: x[1][0])
    tk = Tokenizer(models.Unigram([("<unk>", 0.0), *((p, s) for p, (_, s) in order)], unk_id=0, byte_fallback=False))
    known = set(c.v.pieces)
    for text in [r.text for r in docs.limit(60).collect()] + [t for t in TEXTS if unigram.MARK not in t]:
        if not text:
            continue
        whole = unigram.MARK + text.replace(" ", unigram.MARK)
        e = tk.encode(whole)
        assert c.count(text)[0] == sum(1 if t in known else len(whole[a:b].encode()) for t, (a, b) in zip(e.tokens, e.offsets, strict=True))


# sampled segmentations


def test_a_word_of_200000_letters():
    code = """
import random, resource, sys
sys.path.insert(0, ".")
from pairweave.llm import segment
s, d = segment.Sampler(), segment.Decoder()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = random.Random(1)
t = "".join(rng.choice("etaoinshrdlu") for _ in range(200000))
got = s.sample(t, 5)
assert [d.decode(x[0].tolist()) for x in got] == [t, t] and got[0][0].tolist() != got[1][0].tolist()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert float(out) < 300


def test_a_small_table_changes_no_sample():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("etaoinsr") for _ in range(rng.randint(1, 9))) for _ in range(60)) + "\n" for _ in range(40)]
    small, large = segment.Sampler(cache=50), segment.Sampler()
    got = [small.sample_all([t], [i])[0] for i, t in enumerate(texts)]
    for a, b in zip(got, large.sample_all(texts, list(range(40))), strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
        assert [y for x in a for y in x[1:]] == pytest.approx([y for x in b for y in x[1:]])
    assert len(small.names) < 200


# mixing


def test_positions_integrate_the_schedule(docs):
    """Until its position, the integral of a source's weight is what comes before the document."""
    rows = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    order = {s: i for i, s in enumerate(sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode())))}
    for s, i in order.items():
        slope = mixing.SLOPE * (2 * i / (len(order) - 1) - 1)
        own = sorted((r for r in rows if r.source == s), key=lambda r: (hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id))
        words, steps = 0, 4000
        for r in own:
            if r.position is not None:
                t = (np.arange(steps) + 0.5) / steps * r.position
                met = float((r.target * (1 + slope * (2 * t - 1))).mean() * r.position)
                assert met == pytest.approx(words, abs=1e-3 * r.target + 1e-6)
            words += r.size


def test_the_written_mix_keeps_its_order(spark, docs, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        mix = mixing.mix_documents(docs)
        want = [r.doc_id for r in mix.collect()]
        mix.write.parquet(str(tmp_path / "mix"))
        back = mixing.training_order(spark.read.parquet(str(tmp_path / "mix"))).orderBy("file", "row").collect()
        assert [r.doc_id for r in back] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert mixing.training_order(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first().file is None


# near duplicates


def families(n, copies):
    rng = random.Random(6)
    head = [f"h{i}" for i in range(60)]
    rows = []
    for f in range(n):
        own = [f"f{f}_{i}" for i in range(60)]
        for _ in range(copies):
            words = head + own
            words[rng.randrange(60, 120)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_no_bitmap_gives_the_same_components(spark, monkeypatch):
    docs = spark.createDataFrame(families(12, 3), "doc_id long, text string")
    of = lambda: sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 2, 80).collect())
    want = of()
    assert len({c for _, c in want}) == 12
    monkeypatch.setattr(neardup, "MOST_BITS", 0)
    assert of() == want


# samples, slices and names


def test_samples_equal_the_lowest_hashes(spark, monkeypatch):
    rows = spark.range(20000).selectExpr("id as doc_id", "if(id % 10 < 9, 'hot', if(id % 3 = 0, 'a', null)) as kind").where("kind is not null")
    h = rows.selectExpr("doc_id", "kind", "shiftrightunsigned(xxhash64(doc_id, 4), 11) as h").collect()
    want = sorted(d for kind in ("hot", "a") for d in sorted((r.h, r.doc_id) for r in h if r.kind == kind)[:300])
    for most in (sampling.MOST_CLASSES, 0):
        monkeypatch.setattr(sampling, "MOST_CLASSES", most)
        got = sampling.lowest_by_hash(rows, "kind", 300, 4).collect()
        assert sorted(r.doc_id for r in got) == sorted(d for _, d in want)


def test_slices_are_bounded_by_bytes():
    sizes = [0, 10, 5000, 3, 3, 900, 900, 900, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes]), pa.array(range(9))], names=["t", "n"])
    parts = list(arrow.slices(batch.slice(1), 3, 1000))
    assert [r for p in parts for r in p.column(1).to_pylist()] == list(range(1, 9))
    assert all(p.num_rows == 1 or (p.num_rows <= 3 and sum(len(x) for x in p.column(0).to_pylist()) <= 1000) for p in parts)


def test_names_of_columns_clash_with_nothing(odd, labels, monkeypatch):
    monkeypatch.setattr(pii, "PASSES", 200)  # what the tagger adds is no matter here
    extra = ("c0", "c1", "i0", "weight", "perturbed", "texts", "samples", "payload", "error", "feature", "_kept", "_kept_id", "_pw_text", "_pw_weight", "_pw_key", "position", "file", "row")
    wide = odd.withColumns({c: F.lit(1) for c in extra})
    kept = neardup.keep_one_of_each(wide)
    assert quality.keep_selected(wide, labels).columns == wide.columns == kept.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert pii.masked(wide).columns == wide.columns and mixing.mix_documents(wide).columns == wide.columns
    back = segment.decode(segment.encode(wide.drop("samples"), keep=("text", "texts", "c0", "i0"))).collect()
    assert all(r.texts is None if r.text is None else set(r.texts) == {r.text} for r in back) and back[0].c0 == 1
    media = jpeg.stored(wide).withColumns({c: F.lit("1") for c in ("payload", "c0", "i0", "feature")})
    assert {r.payload[:3] for r in jpeg.media_features(media).where("doc_id = 1").collect()} == {b"the"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_read_odd_tables(spark, odd, none, labels, tmp_path, monkeypatch, name):
    monkeypatch.setattr(pii, "PASSES", 200)
    for at, table in (("odd", odd), ("none", none)):
        table.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{at}/labels.parquet")
        assert queries.QUERIES[name](spark, f"{tmp_path}/{at}").count() == table.count()
