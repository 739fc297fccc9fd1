"""Substring dedup by prefix-partitioned suffix trees.

Suffixes are dealt out by prefixes of variable length (see repeats): counted first, and
made longer where more than a task should hold begin with one. Each part's subtree is
built alone: suffixes in order, from ranks that double their depth, the lengths of the
prefixes that neighbours share, and from these the internal nodes. A node as deep as
the window with leaves in two documents is a repeat, and its leaf in the smallest
document keeps its words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Contexts, cleaned, repeated_spans

WINDOW = 50


class SubTree:
    """The suffix tree below one prefix, as suffix order and shared lengths.

    ids: word numbers, a zero behind each text; starts: where the suffixes begin; stops:
    where their texts end; longest: of the suffixes.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, longest: int) -> None:
        steps = max(1, int(longest).bit_length())
        padded = np.concatenate([ids, np.zeros(2 << steps, np.int64)])
        levels = [padded]
        for k in range(steps - 1):  # ranks of the words from a place on: 1, 2, 4, ...
            rank, far = levels[-1], 1 << k
            pair = rank[: len(rank) - far] * (len(padded) + 1) + rank[far:]
            levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        rest = max(0, longest - (1 << (steps - 1)))
        top = levels[-1]
        self.order = np.argsort(top[starts] * (len(padded) + 1) + top[starts + rest], kind="stable")
        p, q = starts[self.order[:-1]], starts[self.order[1:]]
        shared = np.zeros(len(p), np.int64)
        for k in range(steps - 1, -1, -1):
            shared += (levels[k][p + shared] == levels[k][q + shared]).astype(np.int64) << k
        left = (stops - starts)[self.order]
        #: Words each suffix in order shares with the one before it; the first has none before it.
        self.shared = np.concatenate([[0], np.minimum(shared, np.minimum(left[:-1], left[1:]))])

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The uppermost nodes at a depth or below, as runs of suffixes in order: where each
        begins, and the node of every suffix. A run of one suffix is a leaf."""
        begin = np.flatnonzero(self.shared < depth)
        own = np.empty(len(self.order), np.int64)
        own[self.order] = np.cumsum(self.shared < depth) - 1
        return begin, own


def first_contexts(own: Contexts) -> np.ndarray:
    """For every window the least rank among the leaves below its node at the window's depth."""
    row, inner = own.windows()
    if not len(row):
        return np.empty(0, np.int64)
    starts, stops = own.begin[row] + inner, (own.begin + own.counts)[row]
    tree = SubTree(own.ids, starts, stops, int(own.counts.max()))
    begin, node = tree.nodes(own.window)
    return np.minimum.reduceat(own.rank[row][tree.order], begin)[node]


def find_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document with any: doc_id, tid, spans (start, stop, first_doc_id, first_start)."""
    return repeated_spans(documents, window, first_contexts, "substring")


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text.

    Words are runs without ASCII white space, unchanged. A word goes when a window of
    so many consecutive words covers it whose sequence also starts in a document with a
    smaller doc_id; windows are judged on the input. Null and empty texts and texts
    shorter than a window keep all words, as do rows with a null doc_id, which are not
    compared. Rows of one doc_id never remove from each other. Other columns are not
    looked at; an empty table gives no rows.
    """
    return cleaned(documents, find_repeats(documents, window))


def report(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same with kept_sha256 in place of the text."""
    kept = remove_repeats(documents, window)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
