"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

The base patterns are found in linear time. The tagger is a bidirectional LSTM over
character classes with a linear-chain CRF on top, written and trained in numpy from
spans that the base patterns label in a bounded sample of documents, plus generated
windows with the same kinds in other spellings. It reads overlapping windows; the spans
that it decodes in all of them are reconciled for the document as a whole by weighted
interval scheduling. Base spans always stay; an added span must not touch one, needs a
posterior of at least ``confidence`` and the plain shape of its kind.

A window without ``@`` and with fewer than four digits cannot hold a span of any kind
that passes its shape, so such windows are not read; this changes no result. Windows are
tagged a fixed number at a time as they come, so memory does not grow with a text's
windows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.arrow import map_rows

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an @ that training reads at most, and windows that it uses at most.
FIT_DOCS, FIT_WINDOWS = 400, 1000
WINDOW, STRIDE, TRAIN_WINDOW = 128, 64, 64
HIDDEN, EMBED, BATCH, SEED = 16, 8, 50, 23
#: Windows that training goes through in all, whatever their number.
PASSES = 6500
#: Places with a digit or an @ that training looks at in a document at most, chosen by a hash, and windows of a document without a span.
FIT_PLACES, FIT_NEGATIVES = 40, 2
#: Windows that are tagged together.
TOGETHER = 256
CONFIDENCE = 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        # the local part is the run before this @, no further back than the last match
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)  # no later local part crosses this @
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            parts = m.group().split(".")
            start = m.start()
            while len(parts) >= 4:
                four, parts = parts[:4], parts[4:]
                end = start + sum(map(len, four)) + 3
                if _octets(four):
                    out.append((start, end, "ip"))
                start = end + 1
        for m in _CARD.finditer(text):
            if len(m.group()) >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# character classes: 0 padding, 1 lower, 2 upper, 3 digit, 4 other letter, 5 space, 6 line end, others one each
_SIGNS = ".@-+()_%#:/\"=,!|&$*"
N_CLASSES = 8 + len(_SIGNS)
_ASCII = np.full(129, 7, np.uint8)
_ASCII[128] = 4
_ASCII[97:123], _ASCII[65:91], _ASCII[48:58] = 1, 2, 3
_ASCII[[32, 9]], _ASCII[[10, 13]] = 5, 6
for _i, _c in enumerate(_SIGNS):
    _ASCII[ord(_c)] = 8 + _i
TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _ASCII[np.minimum(points, 128)]


def window_starts(c: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text's classes that can hold a span: with an @ or four digits."""
    n = -(-len(c) // STRIDE)
    if not n:
        return np.zeros(0, np.int64)
    per = WINDOW // STRIDE
    stride = np.arange(0, len(c), STRIDE)
    both = [np.concatenate((np.add.reduceat((c == k).astype(np.int64), stride), np.zeros(per, np.int64))) for k in (3, 8 + _SIGNS.index("@"))]
    digits, signs = (sum(x[i : i + n] for i in range(per)) for x in both)
    return np.flatnonzero((signs > 0) | (digits >= 4)) * STRIDE


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, b, k in spans:
        t = 1 + 2 * KINDS.index(k)
        out[a] = t
        out[a + 1 : b] = t + 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Tagger:
    """Bidirectional LSTM over character classes with CRF transitions."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        f = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": f(N_CLASSES, e) * np.float32(np.sqrt(N_CLASSES) / 2), "out": f(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "lr":
            self.p["x" + d], self.p["h" + d] = f(e, 4 * h), f(h, 4 * h)
            b = np.zeros(4 * h, np.float32)
            b[h : 2 * h] = 1
            self.p["b" + d] = b
        # an inside tag follows only a tag of its kind
        self.allowed = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.allowed[[i for i in range(TAGS) if i not in (inside, inside - 1)], inside] = -1e4
        self.begin = np.zeros(TAGS, np.float32)
        self.begin[2::2] = -2.0  # a window may begin inside a span

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x (T, B, E) in reading order of the direction; hidden states and what backward needs."""
        t, b, _ = x.shape
        h, p = HIDDEN, self.p
        z_in = x.reshape(t * b, -1) @ p["x" + d] + p["b" + d]
        z_in = z_in.reshape(t, b, 4 * h)
        hs, cs, gates = np.zeros((t + 1, b, h), np.float32), np.zeros((t + 1, b, h), np.float32), np.empty((t, b, 4 * h), np.float32)
        for i in range(t):
            z = z_in[i] + hs[i] @ p["h" + d]
            g = gates[i]
            g[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cs[i + 1] = g[:, h : 2 * h] * cs[i] + g[:, :h] * g[:, 3 * h :]
            hs[i + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[i + 1])
        return hs[1:], [x, hs, cs, gates]

    def _lstm_back(self, grad: np.ndarray, kept: list, d: str, g_out: dict) -> np.ndarray:
        x, hs, cs, gates = kept
        t, b, h = grad.shape
        w = self.p["h" + d]
        dh, dc, dz = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), np.empty((t, b, 4 * h), np.float32)
        for i in range(t - 1, -1, -1):
            g, th = gates[i], np.tanh(cs[i + 1])
            gi, gf, go, gg = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            dh = dh + grad[i]
            dc = dc + dh * go * (1 - th * th)
            z = dz[i]
            z[:, :h] = dc * gg * gi * (1 - gi)
            z[:, h : 2 * h] = dc * cs[i] * gf * (1 - gf)
            z[:, 2 * h : 3 * h] = dh * th * go * (1 - go)
            z[:, 3 * h :] = dc * gi * (1 - gg * gg)
            dc = dc * gf
            dh = z @ w.T
        flat = dz.reshape(t * b, -1)
        g_out["x" + d] = x.reshape(t * b, -1).T @ flat
        g_out["h" + d] = hs[:-1].reshape(t * b, -1).T @ flat
        g_out["b" + d] = flat.sum(0)
        return (flat @ self.p["x" + d].T).reshape(x.shape)

    def _emit(self, c: np.ndarray) -> tuple[np.ndarray, tuple]:
        """c (B, T) classes; emissions (T, B, TAGS)."""
        x = self.p["emb"][c.T]
        left, kl = self._lstm(x, "l")
        right, kr = self._lstm(x[::-1], "r")
        both = np.concatenate((left, right[::-1]), 2)
        return both @ self.p["out"] + self.p["bias"], (both, kl, kr)

    def _sums(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of the paths up to and from every position, and of all."""
        t, b, k = em.shape
        a = self.p["trans"] + self.allowed
        fwd, bwd = np.empty_like(em), np.zeros_like(em)
        fwd[0] = em[0] + self.begin
        ea = np.exp(a)
        for i in range(1, t):
            m = fwd[i - 1].max(1, keepdims=True)
            fwd[i] = np.log(np.exp(fwd[i - 1] - m) @ ea + 1e-30) + m + em[i]
        for i in range(t - 2, -1, -1):
            x = bwd[i + 1] + em[i + 1]
            m = x.max(1, keepdims=True)
            bwd[i] = np.log(np.exp(x - m) @ ea.T + 1e-30) + m
        m = fwd[-1].max(1, keepdims=True)
        return fwd, bwd, np.log(np.exp(fwd[-1] - m).sum(1)) + m[:, 0]

    def gradient(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags y (B, T) and its gradient."""
        em, (both, kl, kr) = self._emit(c)
        t, b, k = em.shape
        fwd, bwd, z = self._sums(em)
        yt, at = y.T, np.arange(b)
        a = self.p["trans"] + self.allowed
        score = self.begin[yt[0]] + em[0, at, yt[0]]
        d_em = np.exp(fwd + bwd - z[None, :, None])
        d_tr = np.zeros((k, k), np.float32)
        for i in range(1, t):
            score = score + a[yt[i - 1], yt[i]] + em[i, at, yt[i]]
            pair = np.exp(fwd[i - 1][:, :, None] + a[None] + (em[i] + bwd[i])[:, None, :] - z[:, None, None])
            d_tr += pair.sum(0)
            np.subtract.at(d_tr, (yt[i - 1], yt[i]), 1)
        for i in range(t):
            d_em[i, at, yt[i]] -= 1
        d_em, d_tr = (d_em / b).astype(np.float32), d_tr / b
        g = {"trans": d_tr, "bias": d_em.sum((0, 1)), "out": both.reshape(t * b, -1).T @ d_em.reshape(t * b, -1)}
        d_both = d_em @ self.p["out"].T
        dx = self._lstm_back(d_both[:, :, :HIDDEN], kl, "l", g)
        dx = dx + self._lstm_back(d_both[::-1, :, HIDDEN:], kr, "r", g)[::-1]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], c.T, dx)
        return float((z - score).mean()), g

    def train(self, c: np.ndarray, y: np.ndarray, epochs: int, seed: int = SEED) -> list[float]:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(c)), 0.0
            for s in range(0, len(c), BATCH):
                loss, g = self.gradient(c[order[s : s + BATCH]], y[order[s : s + BATCH]])
                total, step = total + loss, step + 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                rate = 0.02 * (1 - 0.8 * epoch / epochs)
                for k in self.p:
                    x = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(total / max(1, -(-len(c) // BATCH)))
        return losses

    def spans(self, c: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
        """For each window (B, T): spans of the best path with their mean posterior."""
        em, _ = self._emit(c)
        t, b, k = em.shape
        fwd, bwd, z = self._sums(em)
        post = np.exp(fwd + bwd - z[None, :, None])
        a = self.p["trans"] + self.allowed
        best, back = em[0] + self.begin, np.empty((t, b, k), np.int8)
        for i in range(1, t):
            x = best[:, :, None] + a[None]
            back[i] = x.argmax(1)
            best = x.max(1) + em[i]
        path = np.empty((t, b), np.int64)
        path[-1] = best.argmax(1)
        at = np.arange(b)
        for i in range(t - 1, 0, -1):
            path[i - 1] = back[i, at, path[i]]
        out: list[list[tuple[int, int, str, float]]] = []
        for w in range(b):
            row, found, i = path[:, w], [], 0
            if row.any():
                while i < t:
                    if row[i]:
                        kind, j = (row[i] - 1) // 2, i + 1
                        while j < t and row[j] == 2 + 2 * kind:
                            j += 1
                        found.append((i, j, KINDS[kind], float(post[np.arange(i, j), w, row[i:j]].mean())))
                        i = j
                    else:
                        i += 1
            out.append(found)
        return out


def _generated(rng: np.random.Generator, n: int) -> list[tuple[str, list[Span]]]:
    """Windows of filler with one span each, in spellings beyond the base patterns too."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda a, b: "".join(rng.choice(letters, rng.integers(a, b)))
    digits = lambda m: "".join(map(str, rng.integers(0, 10, m)))
    out = []
    for i in range(n):
        kind = KINDS[i % len(KINDS)]
        if kind == "email":
            s = f"{word(2, 9)}{rng.choice(['.', '_', ''])}{digits(rng.integers(0, 3))}@{word(2, 7)}{digits(rng.integers(0, 2))}.{word(2, 8)}{rng.choice(['', '.com', '.org'])}"
        elif kind == "ip":
            s = ".".join(str(x) for x in rng.integers(1, 256, 4))
        elif kind == "card":
            sep = str(rng.choice(["", " ", "-", "."]))
            s = sep.join(digits(4) for _ in range(4))
        else:
            s = str(rng.choice(["+1 (%s) %s-%s", "(%s) %s-%s", "%s-%s-%s", "+%s %s %s"])) % (digits(3), digits(3), digits(4))
        head, tail = " ".join(word(1, 8) for _ in range(6)), " ".join(word(1, 8) for _ in range(8))
        cut = int(rng.integers(0, 30))
        head = head[cut:] + " "
        text = head + s + rng.choice([" ", ". ", ", ", "\n"]) + tail
        out.append((text, [(len(head), len(head) + len(s), kind)]))
        if i % 3 == 0:  # numbers that are none of the kinds
            other = str(rng.choice([digits(3), f"version {digits(1)}.{digits(1)}", f"token = \"{digits(4)}{word(2, 4)}{digits(6)}{word(3, 6)}\"", digits(12), f"{digits(4)}-{digits(2)}"]))
            out.append((head + other + " " + tail, []))
    return out


def _training_windows(texts: list[str], most: int, rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Windows around base spans, their digits redrawn, and FIT_NEGATIVES windows with digits of a text without a span."""
    out: list[tuple[str, list[Span]]] = []
    for text in texts:
        spans = base_spans(text)
        marks = [(a, b) for a, b, _ in spans]
        if not marks:
            found = [m.span() for m in _TRIGGER.finditer(text)]
            marks = found[:: max(1, len(found) // FIT_NEGATIVES)][:FIT_NEGATIVES]
        for a, b in marks:
            lo = max(0, a - int(rng.integers(4, 40)))
            hi = lo + TRAIN_WINDOW
            inside = [(max(x, lo) - lo, min(y, hi) - lo, k) for x, y, k in spans if x < hi and y > lo]
            piece = text[lo:hi]
            if any(x <= a < y and k != kind for x, y, k in spans for a, _, kind in spans if a != x):
                continue  # overlapping kinds
            piece = re.sub(r"[0-9]", lambda _: str(int(rng.integers(0, 10))), piece)
            out.append((piece, inside))
            if len(out) >= most:
                return out
    return out


def fit(texts: list[str], windows: int = FIT_WINDOWS, seed: int = SEED) -> Tagger:
    """A tagger trained on at most ``windows`` labelled windows of the texts and about 400 generated ones."""
    rng = np.random.default_rng(seed)
    rows = _training_windows(texts, windows, rng) + _generated(rng, 300)
    c, y = np.zeros((len(rows), TRAIN_WINDOW), np.int64), np.zeros((len(rows), TRAIN_WINDOW), np.int64)
    for i, (text, spans) in enumerate(rows):
        x = classes(text)[:TRAIN_WINDOW]
        c[i, : len(x)] = x
        y[i] = tags_of([(a, min(b, TRAIN_WINDOW), k) for a, b, k in spans if a < TRAIN_WINDOW], TRAIN_WINDOW)
    tagger = Tagger(seed)
    tagger.train(c, y, -(-PASSES // len(rows)), seed)
    return tagger


def plausible(kind: str, s: str) -> bool:
    """The plain shape that an added span of a kind must have."""
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+", s))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:[^0-9][0-9]{1,3}){3}", s)) and _octets(re.findall(r"[0-9]+", s))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\x20.\-]{0,2}[0-9])+", s)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9().\x20\-]*[().\x20\-][0-9().\x20\-]*[0-9]", s)) and 9 <= len(digits) <= 15


def reconciled(found: list[tuple[int, int, str, float]], fixed: list[Span]) -> list[Span]:
    """The non-overlapping spans of largest total posterior times length, clear of the fixed ones."""
    blocks: list[list[int]] = []  # the fixed spans, joined where they overlap
    for x, y, _ in sorted(fixed):
        if blocks and x < blocks[-1][1]:
            blocks[-1][1] = max(blocks[-1][1], y)
        else:
            blocks.append([x, y])
    starts = [x for x, _ in blocks]

    def clear(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1  # the last block that starts before the end
        return i < 0 or blocks[i][1] <= a

    free = {(a, b, k): p for a, b, k, p in sorted(found, key=lambda x: x[3]) if a < b and clear(a, b)}
    order = sorted(free, key=lambda s: (s[1], s[0], KINDS.index(s[2])))
    ends = [s[1] for s in order]
    best, before, taken = [0.0], [], []  # by number of spans looked at: the best sum; where it goes on from
    for i, s in enumerate(order):
        j = bisect_right(ends, s[0], 0, i)
        gain = best[j] + free[s] * (s[1] - s[0])
        taken.append(gain > best[i])
        before.append(j)
        best.append(max(gain, best[i]))
    out, i = [], len(order)
    while i:
        if taken[i - 1]:
            out.append(order[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


class Finder:
    """Finds all spans of texts with a trained tagger."""

    def __init__(self, tagger: Tagger, confidence: float = CONFIDENCE) -> None:
        self.tagger, self.confidence = tagger, confidence

    def __call__(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """For each text the base spans and all spans."""
        base = [base_spans(t or "") for t in texts]
        found: dict[int, list] = {}
        windows, where = np.zeros((TOGETHER, WINDOW), np.uint8), []

        def tag() -> None:
            for (i, start), spans in zip(where, self.tagger.spans(windows[: len(where)]), strict=True):
                for a, b, k, p in spans:
                    text = texts[i]
                    a, b = a + start, min(b + start, len(text))
                    piece = text[a:b]
                    lead = len(piece) - len(piece.lstrip(" .,;:\n"))
                    a, b = a + lead, a + lead + len(piece.strip(" .,;:\n"))
                    if p >= self.confidence and plausible(k, text[a:b]):
                        found.setdefault(i, []).append((a, b, k, p))
            where.clear()

        for i, text in enumerate(texts):
            if not text or not _TRIGGER.search(text):
                continue
            c = classes(text)
            for s in window_starts(c).tolist():
                x = c[s : s + WINDOW]
                windows[len(where), : len(x)], windows[len(where), len(x) :] = x, 0
                where.append((i, s))
                if len(where) == TOGETHER:
                    tag()
        if where:
            tag()
        out = []
        for i, spans in enumerate(base):
            more = reconciled(found[i], spans) if i in found else []
            out.append((spans, in_order([*spans, *more]) if more else spans))
        return out


def fit_on(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Tagger:
    """Train on at most fit_docs documents with a digit or an @, chosen by a hash of their text, and FIT_PLACES places in each."""
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.expr(f"xxhash64(text, {SEED})").alias("h"))
    least = rows.select("h").distinct().orderBy("h").limit(fit_docs).agg(F.max("h")).first()[0]
    if least is None:
        return fit([])
    # long texts are cut around their triggers on the executors: training needs windows only
    places = "transform(regexp_extract_all(text, '(?s).{0,60}[0-9@].{0,80}', 0), x -> struct(xxhash64(x) as h, x as x))"
    near = F.expr(f"array_join(transform(slice(array_sort({places}), 1, {FIT_PLACES}), p -> p.x), ' ')")
    texts = [r["t"] for r in rows.where(F.col("h") <= least).groupBy("h").agg(F.first(near).alias("t")).orderBy("h").collect()]
    return fit(texts)


def find_spans(docs: DataFrame, fit_docs: int = FIT_DOCS, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, counts by kind of all spans, base_sha256, spans, for every row of docs.

    A null text counts as empty and has no span. Offsets count code points, ends are
    exclusive. Texts are read whole; time and memory grow in proportion to their length.
    Repeated rows get equal results; of added spans that overlap with equal sums the one
    that ends first stays. Rows with a null doc_id are searched like others. An empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    tagger = fit_on(docs, fit_docs)

    def make():
        finder = Finder(tagger, confidence)

        def run(texts):
            n: list[list] = [[] for _ in KINDS]
            sha, spans = [], []
            for base, every in finder(texts):
                for i, k in enumerate(KINDS):
                    n[i].append(sum(s[2] == k for s in every))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            return [*n, sha, spans]

        return run

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return map_rows(docs.select("doc_id", "text"), make, f"{columns}, base_sha256 string, spans string", keep=1)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, fit_docs: int = FIT_DOCS, confidence: float = CONFIDENCE) -> DataFrame:
    """docs with its columns, personal data in text replaced by its kind; n_chars follows, if there.

    Nulls stay null. What counts as personal data, and edges, as in `find_spans`; every
    span that it returns is replaced. An empty table gives an empty result.
    """
    tagger = fit_on(docs, fit_docs)

    def make():
        finder = Finder(tagger, confidence)

        def run(texts):
            new = [t if t is None or not every else mask(t, every) for t, (_, every) in zip(texts, finder(texts), strict=True)]
            return [new]

        return run

    rest = [c for c in docs.columns if c != "text"]
    done = map_rows(docs.select(*rest, "text"), make, "text string", keep=len(rest))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(docs.columns)
