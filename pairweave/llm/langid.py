"""Language identification by averaged hashed subword embeddings and a linear softmax.

The text vector is the mean of the embeddings of the hashed byte 2- to 4-grams of its
words (each word with its boundaries). Embeddings and softmax weights are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled rows.
A temperature and a rejection threshold are calibrated on a part of the sample that
training does not see; a sample of less than ten rows a language is not split, and then
there is no calibration (temperature 1, nothing rejected). Averaging is linear, so prediction folds embeddings and weights
into one table of class logits per bucket, which is exact.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.arrow import map_rows
from pairweave.llm.sampling import lowest_by_hash, remainder

BUCKETS, DIM, EPOCHS, SEED = 1 << 15, 16, 6, 5
#: Labelled rows of each language that training uses at most.
FIT_ROWS = 250

_LETTER = re.compile(r"[^\W\d_]")
_WORD_BYTE = np.full(256, 32, np.uint8)
_WORD_BYTE[97:123] = np.arange(97, 123)
_WORD_BYTE[65:91] = np.arange(97, 123)
_WORD_BYTE[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; signs like a raised two or a circled one are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every subword of the text; empty if it has no letter."""
    if not has_letter(text):
        return np.zeros(0, np.int64)
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    data = _WORD_BYTE[data]
    space = data == 32
    code = data.astype(np.uint32)
    out, gram = [], code
    inner = None
    for n in (2, 3, 4):
        gram = (gram[:-1] << np.uint32(8)) | code[n - 1 :]
        # a gram may start or end at a word boundary but not contain one inside
        keep = ~(space[: len(gram)] & space[1 : 1 + len(gram)]) if n == 2 else inner[:-1] & ~space[n - 2 : n - 2 + len(gram)]
        inner = keep if n > 2 else np.ones(len(gram), bool)
        h = (gram[keep] ^ np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out.append(h >> np.uint32(32 - 15))
    return np.concatenate(out).astype(np.int64)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = SEED) -> dict:
    """Train on (language, distinct buckets, their counts); a model without languages if there are no rows."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "temperature": 1.0, "reject": 0.0}
    at = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 10 * len(langs) else order[:0]
    train = order[len(held) :]
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(langs)), np.float32)
    w += rng.normal(0, 0.1, w.shape)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            lang, idx, n = rows[i]
            if not len(idx):
                continue
            share = (n / n.sum()).astype(np.float32)
            v = share @ e[idx]
            z = v @ w
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at[lang]] -= 1
            back = w @ p
            w -= 0.25 * rate * np.outer(v, p)
            e[idx] -= rate * share[:, None] * back[None, :] * 20
    table = (e @ w).astype(np.float32)
    z, y = [], []
    for i in held:
        lang, idx, n = rows[i]
        if len(idx):
            z.append((n / n.sum()) @ table[idx])
            y.append(at[lang])
    best, reject = 1.0, 0.0
    if z:
        z, y = np.array(z), np.array(y)

        def loss(t: float) -> float:
            q = z / t
            q = q - q.max(1, keepdims=True)
            return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

        best = min((float(x) for x in np.geomspace(0.1, 4, 40)), key=loss)
        q = np.exp((z - z.max(1, keepdims=True)) / best)
        p = (q / q.sum(1, keepdims=True)).max(1)
        right = p[(z.argmax(1) == y)]
        reject = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return {"langs": langs, "table": table, "temperature": best, "reject": min(reject, 0.9)}


def predict_one(model: dict, text: str | None) -> tuple[str, float]:
    h = buckets(text)
    if not len(h) or not model["langs"]:
        return "und", 0.0
    z = model["table"][h].mean(0, dtype=np.float64) / model["temperature"]
    p = np.exp(z - z.max())
    p /= p.sum()
    i = int(p.argmax())
    return model["langs"][i], float(p[i])


def fit_on(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on at most fit_rows rows of each language whose crc32 fold is not 0."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(5) != 0) & F.col("text").isNotNull())
    chosen = lowest_by_hash(known, "lang", fit_rows, SEED)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", "text")

    def make():
        def run(texts):
            pairs = [np.unique(buckets(x), return_counts=True) for x in texts]
            return [[p[0].astype(np.int32) for p in pairs], [p[1].astype(np.int32) for p in pairs]]

        return run

    got = map_rows(rows, make, "idx array<int>, n array<int>", keep=2).orderBy("doc_id", "lang").collect()
    return fit([(r["lang"], np.array(r["idx"], np.int64), np.array(r["n"], np.float64)) for r in got])


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    lang_pred is a learned value, or ``und`` where the text is null, empty or has no
    letter (score 0), or where no labelled row exists. score is the calibrated
    probability; rejected marks scores below the calibrated threshold. Of languages with
    equal probability the first by name is taken. Texts are read whole, whatever their
    length. Rows with a null doc_id are predicted, never learned from, and not held out.
    Repeated rows get equal results; an empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    model = fit_on(docs, fit_rows)
    reject = model["reject"]

    def make():
        def run(texts):
            found = [predict_one(model, x) for x in texts]
            return [[x[0] for x in found], [x[1] for x in found], [x[0] == "und" or x[1] < reject for x in found]]

        return run

    rows = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text")
    return map_rows(rows, make, "lang_pred string, score double, rejected boolean", keep=2)
