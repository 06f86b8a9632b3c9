"""A unigram vocabulary over a public piece inventory, its matcher, Viterbi counts and sampling.

The pieces are those of a public sentencepiece model file (a parameter, never copied
here, never trained). That file ranks its pieces but gives no probabilities; the
unigram scores are the logs of a Zipf law over the rank, which needs no corpus.

A text is cut into units before every run of spaces (written as the piece marker),
around line ends and behind words where no piece joins the two sides, so no piece of the inventory spans two
units; this is derived and checked when the vocabulary is loaded.
Code points that no piece covers fall back to the byte pieces, as one unknown with the
unknown's penalty, and neighbouring unknowns are one, as in the public unigram
tokenizers that this follows.
"""

from __future__ import annotations

import functools
import math
import re

import ahocorasick

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: The unit that stands for a marker in the text itself; no unit of other text looks like it.
LITERAL = f"x{MARK}"
#: Punctuation that may be cut off behind a word where no piece of a vocabulary joins the two.
_BEHIND = ".,;:!?|#$%&*"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with their scores, and the automaton which finds them (made when first asked for)."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: int, byte_ids: list[int] | None) -> None:
        self.pieces, self.unknown, self.byte_ids = pieces, unknown, byte_ids
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.text = {i: p for p, (i, _) in pieces.items()}
        used = set().union(*pieces) if pieces else set()
        joined = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isalnum() or a == "_"}
        cut = "".join(c for c in _BEHIND if c not in joined)
        # line ends stand alone where no piece holds one
        alone = "".join(c for c in "\n\r\t" if c not in used)
        line = re.escape(alone)
        # else runs of markers with a word, if the next character can't join it, or with all up to the next marker
        self.unit = re.compile((f"[{line}]|" if alone else "") + f"{MARK}*\\w+(?=[{re.escape(cut)}{MARK}{line}]|\\Z)|{MARK}*[^{MARK}{line}]+|{MARK}+")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece spans two units")

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for p, (i, s) in self.pieces.items():
            out.add_word(p, (len(p), s, i))
        out.make_automaton()
        return out

    def unknown_pieces(self, text: str) -> int:
        """How many ids a run of uncovered text becomes."""
        return len(text.encode("utf-8", "surrogatepass")) if self.byte_ids else 1

    def unknown_ids(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


@functools.lru_cache(maxsize=2)
def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a sentencepiece model file, with Zipf scores by rank."""
    import sentencepiece

    with open(path or default_model(), "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    # the file lists pieces by rank; single characters come last there but every one is a piece
    norm = math.log(sum(1.0 / (r + 2) for r in range(len(normal))))
    pieces = {sp.id_to_piece(i): (i, -math.log(r + 2) - norm) for r, i in enumerate(normal)}
    bytes_ = [i for i in range(n) if sp.is_byte(i)]
    return Vocabulary(pieces, sp.unk_id(), bytes_ if len(bytes_) == 256 else None)


def units(v: Vocabulary, text: str | None) -> list[str]:
    """The units of a text: a marker stands for every space and before a non-empty text.

    A marker in the text itself is a unit of its own, made of unknowns.
    """
    if not text:
        return []
    if MARK in text:
        first, *rest = text.split(MARK)
        out = v.unit.findall(MARK + first.replace(" ", MARK))
        for part in rest:
            out.append(LITERAL)
            out += v.unit.findall(part.replace(" ", MARK))
        return out
    return v.unit.findall(MARK + text.replace(" ", MARK))


def lattice(v: Vocabulary, unit: str) -> list[list[tuple[int, float, int]]]:
    """For each end position the edges (start, score, id) that end there, by start.

    A position that no single-character piece covers gets an unknown edge.
    """
    if unit == LITERAL:
        return [[], [], [(0, v.unknown_score, v.unknown)]]
    ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(unit) + 1)]
    single = [False] * len(unit)
    for last, (length, score, i) in v.automaton.iter(unit):
        ends[last + 1].append((last + 1 - length, score, i))
        if length == 1:
            single[last] = True
    for at, known in enumerate(single):
        if not known:
            ends[at + 1].append((at, v.unknown_score, v.unknown))
    for e in ends:
        e.sort()
    return ends


def viterbi(v: Vocabulary, unit: str) -> tuple[float, int]:
    """Best score and number of pieces of a unit.

    Ties: of equal scores the edge with the earliest start wins (the longest last piece),
    since a later candidate must be strictly better. Neighbouring unknowns are fused.
    """
    if unit == LITERAL:
        return v.unknown_score, v.unknown_pieces(MARK)
    best = [(0.0, 0, 0)]  # score, finished pieces, start of an open run of unknowns or the position
    for end, edges in enumerate(lattice(v, unit)[1:], 1):
        top, pick = -math.inf, None
        for start, score, i in edges:
            if best[start][0] + score > top:
                top, pick = best[start][0] + score, (start, i)
        start, i = pick
        _, n, run = best[start]
        if i == v.unknown:
            best.append((top, n, run))
        else:
            done = n + (v.unknown_pieces(unit[run:start]) if run < start else 0)
            best.append((top, done + 1, end))
    score, n, run = best[-1]
    return score, n + (v.unknown_pieces(unit[run:]) if run < len(unit) else 0)


class Counter:
    """Piece counts of texts; a bounded cache of units spares equal work."""

    def __init__(self, path: str | None = None, cache: int = 400_000) -> None:
        self.v = load(path)
        self.cache: dict[str, int] = {}
        self.most = cache

    def count(self, text: str | None) -> tuple[int, int]:
        """Number of pieces and of units."""
        total, cache, found = 0, self.cache, units(self.v, text)
        get = cache.get
        for u in found:
            n = get(u)
            if n is None:
                if len(cache) >= self.most:
                    cache.clear()
                n = viterbi(self.v, u)[1]
                if len(u) <= 64:
                    cache[u] = n
            total += n
        return total, len(found)
