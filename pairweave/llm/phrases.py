"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On every level a run of equal symbols is one symbol;
deterministic coin tossing then relabels each symbol by the lowest bit in which it
differs from its left neighbour, again and again until few labels are left, and a phrase
starts at every local maximum of the labels. A phrase's name is a hash of the names in
it, and the names are the symbols of the next level. Where a phrase starts depends on a
few neighbours only, so equal substrings get equal phrases inside, whatever stands before
them. The fingerprint of a text is the name of its top phrase sequence and one minimum
hash for each of a fixed number of bins over the names of two levels.

Documents are parsed many at a time in numpy; every document's borders are phrase
borders, and no label looks across them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from pairweave.llm.hashing import U64, mix, salts, utf8

LEVELS = 4
#: Levels whose phrase names enter the bins.
SKETCHED = (2, 3)
BINS = 64
#: Bytes that are parsed at once, at least one document.
CHUNK = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NAMES = salts(256, 29)


def _toss_table(bits: int) -> np.ndarray:
    """Label of a symbol (row: left neighbour, column: symbol) of so many bits; 0 if they are equal."""
    n = 1 << bits
    left, own = np.arange(n)[:, None], np.arange(n)[None, :]
    low = (left ^ own) & -(left ^ own)
    at = np.where(low > 0, np.bitwise_count(np.maximum(low, 1) - 1), 0)
    return (2 * at + ((own >> at) & 1)).astype(np.uint8)


# labels of 8-bit symbols fit in 4 bits, of 7 in 4, of 4 in 3, of 3 in at most 6 labels
_TOSS = {b: _toss_table(b) for b in (8, 7, 4, 3)}


def _tossed(labels: np.ndarray, bits: int, first: np.ndarray) -> np.ndarray:
    """One round on small labels; the first symbol of a document is compared with its own lowest bit flipped."""
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[first] = labels[first] ^ 1
    return _TOSS[bits][left, labels]


def _phrase_starts(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of phrases: local maxima inside a document, and its first symbol."""
    rise = np.empty(len(labels), bool)
    rise[1:] = labels[1:] > labels[:-1]
    rise[0] = True
    fall = np.empty(len(labels), bool)
    fall[:-1] = labels[:-1] > labels[1:]
    fall[-1] = True
    fall[first[1:] - 1] = True  # the last symbol of a document falls off
    top = rise & fall
    top[first] = True
    # a maximum right behind the first symbol would leave a phrase of one symbol
    second = first[first + 1 < len(labels)] + 1
    second = second[~np.isin(second, first)]
    top[second] = False
    return np.flatnonzero(top)


def _joined(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the names of every phrase; it depends on their order and number."""
    n = len(names)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    # phrases are short: the place multiplies the name by an odd number of its own
    weighed = mix(names + at.astype(U64) * U64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(weighed, starts))


def parse(texts: list[bytes | np.ndarray], levels: int = LEVELS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each level from 1 on (phrase names, start of each document in them); and each text's top name.

    texts must not be empty.
    """
    data = np.concatenate(texts)
    first = np.cumsum([0, *map(len, texts[:-1])])
    out = []
    small, names = data, _NAMES[data]
    for level in range(1, levels + 1):
        # runs of equal symbols become one symbol
        new = np.empty(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        new[0] = True
        new[first] = True
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(names)))
        symbols = names[at]
        first = np.searchsorted(at, first)
        if level == 1:
            labels = _tossed(_tossed(_tossed(small[at], 8, first), 4, first), 3, first)
        else:
            left = np.empty_like(symbols)
            left[1:] = symbols[:-1]
            left[first] = symbols[first] ^ U64(1)
            low = left ^ symbols
            low &= ~low + U64(1)
            wide = (np.bitwise_count(low - U64(1)).astype(np.uint8) << np.uint8(1)) | ((symbols & low) != 0).astype(np.uint8)
            labels = _tossed(_tossed(_tossed(wide, 7, first), 4, first), 3, first)
        runs = size > 1
        symbols = symbols.copy()
        symbols[runs] = mix(symbols[runs] + size[runs].astype(U64) * U64(0xD6E8FEB86659FD93))
        starts = _phrase_starts(labels, first)
        names = _joined(symbols, starts)
        first = np.searchsorted(starts, first)
        out.append((names, first))
    # the whole sequence of top phrases, in order
    top = _joined(names, first)
    return out, top


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Top names, and bins (a row of BINS minimum hashes for each text; all ones where a bin is empty)."""
    n = len(texts)
    bins, top = np.full((n, BINS), _EMPTY), np.zeros(n, U64)
    data = [utf8(t) for t in texts]
    at = 0
    while at < n:
        group, size = [], 0
        while at < n and (not group or size + len(data[at]) <= CHUNK):
            if len(data[at]):
                group.append(at)
                size += len(data[at])
            at += 1
        if not group:
            continue
        parsed, names = parse([data[i] for i in group])
        top[group] = names
        flat = np.full(len(group) * BINS, _EMPTY)
        for level in SKETCHED:
            phrase, first = parsed[level - 1]
            owner = np.repeat(np.arange(len(group)), np.diff(np.append(first, len(phrase))))
            h = mix(phrase ^ U64(0xA0761D6478BD642F * level & 0xFFFFFFFFFFFFFFFF))
            np.minimum.at(flat, owner * BINS + (h & U64(BINS - 1)).astype(np.int64), h >> U64(8))
        bins[group] = flat.reshape(len(group), BINS)
    return top, bins


def spelled(top: np.ndarray, bins: np.ndarray) -> list[str]:
    """Fingerprints as strings: the top name, then four hex digits for each bin, or four signs if it is empty."""
    low = (bins & U64(0xFFFF)).tolist()
    full = (bins != _EMPTY).tolist()
    return [f"{t:016x}:" + "".join(f"{v:04x}" if f else "----" for v, f in zip(a, b, strict=True)) for t, a, b in zip(top.tolist(), low, full, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bins that are spelled alike among those that are not empty in both rows; 1 where all are empty.

    Only what the fingerprints spell counts: whether a bin is empty, and its four digits.
    """
    x, y = a != _EMPTY, b != _EMPTY
    n = (x | y).sum(1)
    same = (x & y & ((a & U64(0xFFFF)) == (b & U64(0xFFFF)))).sum(1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def _range_of(edges: list[int], low: int, high: int) -> Column:
    """How many of the borders edges[low:high] and of those before them are below a doc_id, by halving: as many comparisons as the list has digits in binary."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(F.col("doc_id") > F.lit(edges[mid]), _range_of(edges, mid + 1, high)).otherwise(_range_of(edges, low, mid))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id and text, dealt by ranges of descending doc_id, each range followed by the first row of the next.

    Partitions are sorted by range; role 1 marks the borrowed row. Only the borders and the
    largest id of every range (a fixed number of values) pass through the driver, and every
    text is moved once.
    """
    ids = docs.select("doc_id")
    span = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    borders = sorted(set(ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if span[0] is not None else []
    edges = [int(b) for b in borders]
    number = F.lit(0)
    if edges:
        # the number of borders at or above the id: 0 holds the largest ids; null ids join the smallest
        number = F.when(F.col("doc_id").isNull(), len(edges)).otherwise(F.lit(len(edges)) - _range_of(edges, 0, len(edges)))
    rows = docs.select("doc_id", "text", number.alias("range"))
    heads = {r["range"]: r["head"] for r in ids.withColumn("range", number).groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    # by range: its largest id, and the range whose last row needs it (the first lends to the last)
    order = sorted(heads)
    needs = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}
    kind = docs.schema["doc_id"].dataType
    every = range(len(edges) + 1)
    head = F.get(F.array(*[F.lit(heads.get(r)).cast(kind) for r in every]), F.col("range"))
    to = F.get(F.array(*[F.lit(needs.get(r)).cast("int") for r in every]), F.col("range"))
    place = lambda to, role: F.struct(to.cast("int").alias("to"), F.lit(role).alias("role"))
    both = F.when(F.col("doc_id").eqNullSafe(head), F.array(place(F.col("range"), 0), place(to, 1))).otherwise(F.array(place(F.col("range"), 0)))
    dealt = rows.select("doc_id", "text", F.explode(both).alias("at")).select("doc_id", "text", "at.to", "at.role")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "to").sortWithinPartitions(F.col("to"), F.col("role"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def document_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one with the next smaller doc_id, after the smallest the
    largest; null ids come last, and rows with equal ids follow each other by a hash of
    their text. A null text counts as empty; an empty text has the fingerprint without
    names. Texts are parsed whole, whatever their length. A single row is its own next; an
    empty table gives an empty result. near_edited and near_next follow from the spelled
    fingerprints. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, ranges or min(4 * parts, 2000))
    shape = StructType([docs.schema["doc_id"], *_parse_datatype_string(COLUMNS).fields])
    arrow = to_arrow_schema(shape)

    def results(group: list[tuple]) -> pa.RecordBatch:
        """Rows of one range in order, the last of which only serves as a next."""
        texts = [t or "" for _, t in group]
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            n = len(text) // 3
            edited.append(text[: len(text) - n] + after[:n])
        top, bins = fingerprints(texts)
        edited_top, edited_bins = fingerprints(edited)
        columns = [
            [i for i, _ in group[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            spelled(top[:-1], bins[:-1]), spelled(edited_top, edited_bins), likeness(bins[:-1], edited_bins), likeness(bins[:-1], bins[1:]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        held: list[tuple] = []  # rows that wait for their next
        size, now, done = 0, None, False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text, to, role in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if to != now:
                        held, size, now, done = [], 0, to, False
                    if done:
                        continue  # more rows with the id of the borrowed one
                    held.append((i, text))
                    size += len(text or "")
                    done = role == 1
                    if (done or size > CHUNK) and len(held) > 1:
                        yield results(held)
                        held, size = held[-1:], len(held[-1][1] or "")

    return rows.mapInArrow(run, shape)
