"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the classes of a clause's words and are composed into one
deterministic machine (`compose`): insults, threats, targets, negation, reported speech.
Each reads what the one before writes and adds its weight: the first turns a word of one
of the lexicon's weight classes into an insult of that weight; an insult counts more
beside a target, less under a negation or a verb of speech, and a threat needs an
intention, a violent verb and a target. A clause's weight is the sum along its path and
nothing else; a document's score combines its clauses through a calibrated logistic curve.

The insult lexicon with its weight classes, and the curve, are learned from a bounded
sample of labelled rows of the training folds. A word's support is its number of distinct
(previous, word, next) contexts in toxic rows, so copies of one passage count once. Words,
contexts and clauses are counted on the executors; the driver gets counts of candidate
words and of scores, never a text.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.arrow import map_rows
from pairweave.llm.sampling import lowest_by_hash, remainder
from pairweave.plans.scratch import Scratch

#: Labelled rows of each label that learning uses at most.
FIT_ROWS = 4000
#: Words of the learned lexicon at most; those with the largest support are taken.
LEXICON = 400
#: Candidate words whose contexts are counted at most; those in the most toxic rows are taken.
CANDIDATES = 8000
LEAST_SUPPORT, LEAST_ODDS, LEAST_RATIO = 4, 2.5, 16.0
#: Weights of the insult classes; a word's log odds are rounded down to one of them.
WEIGHTS = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0)
#: What a violent verb weighs as a threat before a target is seen.
THREAT = 3.0
#: Clause sums beyond this count alike when the curve is fitted (not when it is applied).
FIT_MOST = 60.0
SEED = 3

# Closed word classes of the grammar.
TARGETS = "you your yours yourself yourselves ur u he him his she her hers they them their this that these those vous ton votre tu toi dich dir du ihr euch usted ustedes te".split()
NEGATIONS = "not no never none nor neither cannot without hardly isn't aren't wasn't weren't don't doesn't didn't won't n't pas jamais nicht kein keine nunca".split()
SPEECH = "said says say saying claimed claims wrote writes quoted reported reports reportedly allegedly called calls according tweeted dit sagte dijo".split()
INTENTIONS = "will shall gonna going i'll we'll must should want wanna".split()
VIOLENCE = "kill murder hurt destroy beat stab shoot strangle punch attack burn hang".split()

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")

CLASSES = ("other", "insult", "target", "negation", "speech", "intention", "violence")
INSULTS = tuple(f"insult {w}" for w in WEIGHTS)
Machine = dict[tuple[int, str], tuple[int, str, float]]


def machine(states: int, arcs: dict[tuple[int, str], tuple[int, str, float]], symbols: tuple[str, ...]) -> tuple[int, Machine]:
    """A complete deterministic transducer: pairs without an arc stay and copy their symbol."""
    return states, {(s, x): arcs.get((s, x), (s, x, 0.0)) for s in range(states) for x in symbols}


def compose(first: tuple[int, Machine], second: tuple[int, Machine]) -> tuple[int, Machine]:
    """The machine which feeds what ``first`` writes to ``second``; weights add."""
    n, m = first[0], second[0]
    arcs: Machine = {}
    for (s, x), (to, y, w) in first[1].items():
        for q in range(m):
            into, z, v = second[1][(q, y)]
            arcs[(s * m + q, x)] = (to * m + into, z, w + v)
    return n * m, arcs


def machines() -> list[tuple[int, Machine]]:
    """The five machines in the order in which each reads what the one before writes."""
    out = (*CLASSES, "threat", "denied")
    # a word of a weight class is an insult of that weight
    insults = machine(1, {(0, x): (0, "insult", w) for x, w in zip(INSULTS, WEIGHTS, strict=True)}, (*out, *INSULTS))
    # a violent verb counts as a threat within four words of an intention
    intent = {(s, "intention"): (4, "intention", 0.0) for s in range(5)}
    intent |= {(s, x): (s - 1, x, 0.0) for s in range(1, 5) for x in CLASSES if x not in ("intention", "violence")}
    intent |= {(s, "violence"): (s, "threat", THREAT) for s in range(1, 5)}
    threats = machine(5, intent, out)
    # a negation weakens what follows within three words
    deny = {(s, "negation"): (3, "negation", 0.0) for s in range(4)}
    deny |= {(s, x): (s - 1, x, 0.0) for s in range(1, 4) for x in ("other", "target", "speech", "intention", "violence")}
    deny |= {(s, x): (s, "denied", -4.0) for s in range(1, 4) for x in ("insult", "threat")}
    negation = machine(4, deny, out)
    # a verb of speech before a hit in the clause weakens it
    reported = machine(2, {(0, "speech"): (1, "speech", 0.0), (1, "insult"): (1, "insult", -1.5), (1, "threat"): (1, "threat", -2.0)}, out)
    # a target beside a hit strengthens it, once on each side; state 1: target seen, 2: threat waits for one
    aim = {(0, "target"): (1, "target", 0.0), (1, "insult"): (1, "insult", 1.0), (1, "threat"): (1, "threat", 3.0), (0, "threat"): (2, "threat", 0.0), (2, "target"): (1, "target", 3.0)}
    targets = machine(3, aim, out)
    return [insults, threats, negation, reported, targets]


def grammar() -> tuple[int, Machine]:
    """The composed machine; it starts in state 0 at every clause."""
    return functools.reduce(compose, machines())


def _classes() -> dict[str, str]:
    table = {}
    for name, group in (("target", TARGETS), ("negation", NEGATIONS), ("speech", SPEECH), ("intention", INTENTIONS), ("violence", VIOLENCE)):
        table |= dict.fromkeys(group, name)
    return table


def insult_class(weight: float) -> str:
    """The weight class of a lexicon entry."""
    return INSULTS[max(i for i, w in enumerate(WEIGHTS) if w <= max(weight, WEIGHTS[0]))]


class Scorer:
    """Scores texts with a learned lexicon (word: weight) and curve (scale, bias)."""

    def __init__(self, model: dict) -> None:
        self.scale, self.bias = model["scale"], model["bias"]
        self.arcs = grammar()[1]
        self.classes = _classes() | {w: insult_class(x) for w, x in model["lexicon"].items()}
        triggers = sorted({*model["lexicon"], *VIOLENCE}, key=lambda w: (-len(w), w))
        self.hit = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, triggers)) + r")(?![^\W\d_])")

    def clause(self, text: str) -> float:
        """The weight of one clause; 0 if the grammar accepts nothing in it."""
        state, total, found = 0, 0.0, False
        for w in _WORD.findall(text):
            x = self.classes.get(w, "other")
            state, y, weight = self.arcs[(state, x)]
            found = found or y in ("insult", "denied", "threat")
            total += weight
        return total if found else 0.0

    def raw(self, text: str | None) -> tuple[float, int]:
        """The sum of the matched clauses' weights, and their number."""
        low = (text or "").lower()
        total, n, upto = 0.0, 0, -1
        for m in self.hit.finditer(low):
            if m.start() < upto:
                continue
            begin = upto if upto > 0 else 0
            for e in _CLAUSE_END.finditer(low, begin, m.start()):
                begin = e.end()
            end = _CLAUSE_END.search(low, m.end())
            upto = end.end() if end else len(low)
            w = self.clause(low[begin:upto])
            if w > 0:
                total += w
                n += 1
        return total, n

    def score(self, text: str | None) -> tuple[float, int]:
        raw, n = self.raw(text)
        return 1.0 / (1.0 + math.exp(-(self.scale * raw + self.bias))), n


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def odds_of(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float | None:
    """Log odds of a word in so many toxic and clean rows, if support, odds and likelihood ratio are large enough."""
    if toxic < LEAST_SUPPORT:
        return None
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    mean = (toxic + clean) / (n_clean + n_toxic)
    ratio = 2 * (toxic * math.log(toxic / (n_toxic * mean)) + (clean * math.log(clean / (n_clean * mean)) if clean else 0.0))
    return odds if odds >= LEAST_ODDS and ratio >= LEAST_RATIO else None


def _lexicon(rows: DataFrame, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Words that are far more frequent in toxic rows, with their log odds, from sampled rows (text, toxic).

    The odds grow with the support, so a word that fails with all its toxic rows fails
    with its contexts too and is no candidate.
    """
    spread = map_rows(rows.select("toxic", "text"), lambda: lambda texts: [[list(dict.fromkeys(words_of(t))) for t in texts]], "words array<string>", keep=1)
    counts = spread.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    likely = counts.where((F.col("toxic") >= LEAST_SUPPORT) & (odds >= LEAST_ODDS - 1e-9) & (F.length("word") >= 3) & ~F.col("word").isin(sorted(_classes())))
    first = likely.orderBy(F.desc("toxic"), "word").limit(CANDIDATES).collect()
    seen = {r["word"]: (r["toxic"], r["clean"]) for r in first if odds_of(r["toxic"], r["clean"], n_toxic, n_clean) is not None}
    if not seen:
        return {}

    def make():
        names = frozenset(seen)

        def run(texts):
            out = []
            for t in texts:
                w = ["", *words_of(t), ""]
                out.append(sorted({(w[i], w[i - 1], w[i + 1]) for i in range(1, len(w) - 1) if w[i] in names}))
            return [out]

        return run

    near = map_rows(rows.where("toxic = 1").select("text"), make, "near array<struct<word string, before string, after string>>")
    contexts = near.select(F.explode("near").alias("x")).select("x.*").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a candidate
    kept = {}
    for r in contexts:
        toxic, clean = seen[r["word"]]
        p = min(r["n"], toxic)
        odds = odds_of(p, clean, n_toxic, n_clean)
        if odds is not None:
            kept[r["word"]] = (p, odds)
    return {w: kept[w][1] for w in sorted(kept, key=lambda w: (-kept[w][0], w))[:LEXICON]}


def _curve(counts: list[tuple[float, int, int]], totals: tuple[int, int]) -> tuple[float, float]:
    """Scale and bias of a logistic curve over (clause sum, label, rows) of the sample; totals: the rows that it stands for."""
    n = [sum(k for _, y, k in counts if y == label) for label in (0, 1)]
    share = [totals[y] / max(1, sum(totals)) / max(1, n[y]) for y in (0, 1)]
    x = [(min(r, FIT_MOST), y, share[y] * k) for r, y, k in sorted(counts)]
    a, b = 1.0, -3.0  # drawn to the start values
    for _ in range(500):
        ga, gb = 0.002 * (a - 1.0), 0.002 * (b + 3.0)
        for r, y, w in x:
            d = w * (1 / (1 + math.exp(-(a * r + b))) - y)
            ga, gb = ga + d * r, gb + d
        a, b = a - 0.5 * ga, b - 0.5 * gb
    return max(a, 0.1), min(b, -1.0)


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Lexicon and curve from at most fit_rows rows of each label, of folds other than crc32 mod 3 = 1.

    A word enters the lexicon if its support is LEAST_SUPPORT or more, its log odds are
    LEAST_ODDS or more and its log-likelihood ratio against chance is LEAST_RATIO or more.
    Ties in support go to the smaller word. Without rows of both labels the lexicon is
    empty and the curve keeps its start values.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(3) != 1)).select("doc_id", "toxic").distinct()
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = lowest_by_hash(known, "toxic", fit_rows, SEED)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = {"lexicon": {}, "scale": 1.0, "bias": -3.0}
    if n.get(0) and n.get(1):
        model["lexicon"] = _lexicon(rows, n[0], n[1])

        def make():
            scorer = Scorer(model)
            return lambda texts: [[scorer.raw(t)[0] for t in texts]]

        sums = map_rows(rows.select("toxic", "text"), make, "raw double", keep=1).groupBy("raw", "toxic").agg(F.count(F.lit(1)).alias("n"))
        model["scale"], model["bias"] = _curve([(r["raw"], r["toxic"], r["n"]) for r in sums.collect()], (totals.get(0, 0), totals.get(1, 0)))  # a row a sum, fewer than sampled rows
    scratch.drop(rows)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses for every row of docs.

    A null or empty text has no clause and gets the curve's lowest score. Texts are scored
    whole, whatever their length. Rows with a null doc_id are scored, never learned from,
    and not held out. Repeated rows get equal results, so ties stay ties; an id that has
    both labels is learned from under both. With an empty label table the lexicon is empty
    and only threats score; an empty table of docs gives an empty result. Other columns of
    docs, whatever their names, are not read.
    """
    model = fit_on(docs, labels, fit_rows)

    def make():
        scorer = Scorer(model)

        def run(texts):
            found = [scorer.score(x) for x in texts]
            return [[x[0] for x in found], [int(x[0] >= threshold) for x in found], [x[1] for x in found]]

        return run

    rows = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text")
    return map_rows(rows, make, "score double, predicted int, n_clauses int", keep=2)
