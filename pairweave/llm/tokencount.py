"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text; dynamic
programming carries the best score and the number of pieces of the best path to each
position, and no path. Ties follow the public unigram tokenizers: candidates are seen by
ascending start and only a strictly better one replaces an earlier one; neighbouring
unknowns are one token, or their bytes where the inventory has byte pieces. See
`pairweave.llm.unigram` for the vocabulary and the cut into units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairweave.llm.arrow import calm_collector, map_rows
from pairweave.llm.unigram import Counter


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_units of every row of docs.

    A null or empty text has no tokens. Texts are counted whole, whatever their length;
    time and memory grow in proportion to it. Repeated rows get equal counts; a null
    doc_id stays null; ties between segmentations follow the rule above. An empty table
    gives an empty result. Other columns, whatever their names, are not read. ``model`` is
    the path of a sentencepiece model file that gives the inventory.
    """

    def make():
        calm_collector()
        counter = Counter(model)

        def run(texts):
            found = [counter.count(x) for x in texts]
            return [[x[0] for x in found], [x[1] for x in found]]

        return run

    return map_rows(docs.select("doc_id", "text"), make, "n_tokens long, n_units long", keep=1)
