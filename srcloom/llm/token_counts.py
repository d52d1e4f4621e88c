"""Token counts under a unigram model, by dynamic programming on a trie.

Under a unigram model the best segmentation of a pre-token maximises the sum of
its pieces' scores. The forward score of a prefix (the best sum over its
segmentations, and how many pieces that takes) depends on the prefix alone. So
the distinct new pre-tokens of a slice of texts are put in a trie, held in
arrays: pre-tokens are rows in sorted order, a row's cell is a node of its own
from the depth on where the row differs from the one before it, and above that
it is the node of an earlier row. An Aho-Corasick automaton of the pieces walks
down the trie, so each node knows the pieces that end there; forward scores are
computed depth by depth for all nodes of a depth at once, each node once; the
node where a pre-token ends gives its count.

A document's count is the sum over its pre-tokens. Counts of pre-tokens are kept
by the worker process in two generations of at most TERMINALS each; a trie lives
for one block of pre-tokens. Pre-tokens of more than LONGEST code points take no
nodes: they are scored with a window of as many forward scores as the longest
piece has code points. So neither texts nor pre-tokens are shuffled, and memory
is bounded whatever the texts.

Pieces and their scores come from a SentencePiece file; its pieces are ordered
by frequency, and the score of rank r is taken as the logarithm of Zipf's law,
-ln(r + 2.7). A character without a piece counts as one piece per UTF-8 byte,
at the worst score for each. Equal sums are decided for fewer pieces. Pre-tokens
are words with the blanks before them, each blank as the piece mark; other white
space stays as it is.

Defined cases: null and empty texts have no pre-tokens and no tokens; columns of
the documents that bear a name of an added column are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Recent, appended, table, tables_of
from .matching import LONGEST, Automaton, Nodes, blocks
from .pieces import SPACE, model_path

TERMINALS = 250_000
_PRETOKEN = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Trie:
    """The scores of the pieces, and the counts of recent pre-tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.worst = min(scores.values(), default=-1.0) - 1
        self.terminal = Recent(self._counted, TERMINALS)
        self.values = np.fromiter(scores.values(), np.float64, len(scores))

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(list(self.scores))

    @cached_property
    def library(self):
        """The automaton for one word alone."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, s in self.scores.items():
            found.add_word(p, (len(p), s))
        found.make_automaton()
        return found

    def counts_of(self, lists: list) -> list[list[tuple[int, float]]]:
        """For each collection of pre-tokens: pieces and score of the best segmentation of each."""
        return self.terminal.of(lists)

    def counts(self, word: str) -> tuple[int, float]:
        return self.counts_of([[word]])[0][0]

    def _counted(self, words: list[str]) -> dict[str, tuple[int, float]]:
        plain = [w for w in words if len(w) <= LONGEST]
        out = {w: found for block in blocks(plain) for w, found in zip(block, self._forward(block), strict=True)}
        return out | {w: self._rolling(w) for w in words if len(w) > LONGEST}

    def _forward(self, words: list[str]) -> list[tuple[int, float]]:
        """Sorted distinct pre-tokens: the forward scores at the nodes where they end."""
        trie, auto = Nodes(words), self.automaton
        score, pieces = np.zeros((len(trie.codes) + 1, len(words))), np.zeros((len(trie.codes) + 1, len(words)), np.int64)
        for d, own, states, _ in auto.walk(trie):
            codes = trie.codes[d, own] - 1
            octets = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            n_ends, first = auto.n_ends[states], auto.at_ends[states]
            # the shortest match is the last; without a piece of one code point that one counts by its bytes
            alone = np.zeros(len(own), bool)
            some = np.flatnonzero(n_ends)
            alone[some] = auto.size[auto.ends[first[some] + n_ends[some] - 1]] == 1
            best = np.where(alone, -np.inf, score[d, own] + self.worst * octets)
            fewest = pieces[d, own] + octets
            for k in range(int(n_ends.max(initial=0))):
                some = np.flatnonzero(n_ends > k)
                piece, word = auto.ends[first[some] + k], own[some]
                before = d + 1 - auto.size[piece]
                s, n = score[before, word] + self.values[piece], pieces[before, word] + 1
                better = (s > best[some]) | ((s == best[some]) & (n < fewest[some]))
                best[some[better]], fewest[some[better]] = s[better], n[better]
            score[d + 1, own], pieces[d + 1, own] = best, fewest
            score[d + 1], pieces[d + 1] = score[d + 1, trie.node[d]], pieces[d + 1, trie.node[d]]
        ends = np.arange(len(words))
        return list(zip(pieces[trie.lengths, ends].tolist(), score[trie.lengths, ends].tolist(), strict=True))

    def _rolling(self, word: str) -> tuple[int, float]:
        """The same for one pre-token of any length, with a window of forward scores."""
        room = self.longest + 1
        window = [(0.0, 0)] * room  # (score, -pieces) of the last prefixes
        found = self.library.iter(word)
        hit = next(found, None)
        for at, c in enumerate(word):
            best = None
            if c not in self.scores:
                n = len(c.encode("utf-8", "surrogatepass"))
                before = window[at % room]
                best = (before[0] + self.worst * n, before[1] - n)
            while hit is not None and hit[0] == at:
                size, value = hit[1]
                before = window[(at + 1 - size) % room]
                s = (before[0] + value, before[1] - 1)
                if best is None or s > best:
                    best = s
                hit = next(found, None)
            window[(at + 1) % room] = best
        score, pieces = window[len(word) % room]
        return -pieces, score


def loaded(model_file: str) -> Trie:
    """Scores and recent pre-tokens of this worker process."""
    return tables_of("token_counts", model_file, lambda: _read(model_file))


def _read(model_file: str) -> Trie:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Trie({p: -math.log(r + 2.7) for r, p in enumerate(dict.fromkeys(pieces))})


ADDED = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType())])


def token_counts(docs: DataFrame, text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """docs with n_pretokens, n_tokens (pieces of the best segmentation) and log_score (its sum, to 6 decimals)."""
    file = model_file or model_path()

    def make():
        trie = loaded(file)

        def work(texts: list) -> list[list]:
            often = [Counter(_PRETOKEN.findall(SPACE + t.replace(" ", SPACE))) if t else Counter() for t in texts]
            rows = []
            for c, found in zip(often, trie.counts_of(often), strict=True):
                rows.append((c.total(), sum(n * k for n, (k, _) in zip(c.values(), found, strict=True)), round(math.fsum(n * s for n, (_, s) in zip(c.values(), found, strict=True)), 6)))
            return [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []]

        return work

    return appended(docs, text_col, ADDED, make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *ADDED.names)
