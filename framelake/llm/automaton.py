"""Matching statistics against broadcast suffix automata of reference shards.

The reference is cut into shards of about ``SHARD_WORDS`` words. A suffix automaton of each
shard is built in a task and broadcast; documents stream past all of them. At every word an
automaton tells the longest run of words ending there that the shard has, and every run of at
least ``window`` words goes.

Work is documents times shards, and each task holds all automata, so the reference is
bounded: ``MOST_WORDS`` is checked before anything is built. A corpus that is its own reference
goes through ``substring_dedup``.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, rows_of, text_bytes, with_fields

WINDOW = 20
SHARD_WORDS = 50_000
#: Bound of the reference, in words: an automaton takes about 700 bytes a word.
MOST_WORDS = 400_000


class Automaton:
    """Suffix automaton of several word sequences; no run crosses from one to the next."""

    def __init__(self, sequences: Iterable[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._at_length(last, word, known)
        state = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._at_length(last, word, self.next[last][word])
        return state

    def _at_length(self, before: int, word: bytes, state: int) -> int:
        """``state``, or its copy for the shorter runs, one word longer than those of ``before``."""
        if self.length[state] == self.length[before] + 1:
            return state
        copy = self._state(self.length[before] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def matches(self, words: list[bytes]) -> np.ndarray:
        """For each word the length of the longest known run that ends with it."""
        following, link, length = self.next, self.link, self.length
        out, state, run = [], 0, 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                run = length[state]
            to = following[state].get(word)
            state, run = (0, 0) if to is None else (to, run + 1)
            out.append(run)
        return np.array(out, dtype=np.int64)


def spans(run: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a known run of at least ``window`` words."""
    ends = np.flatnonzero(run >= window)
    step = np.zeros(len(run) + 1, dtype=np.int64)
    np.add.at(step, ends - run[ends] + 1, 1)
    np.add.at(step, ends + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _build(rows: pa.Table) -> pa.Table:
    automaton = Automaton(x.split() for x in text_bytes(rows.column("text").combine_chunks()))
    return pa.table({"automaton": pa.array([pickle.dumps(automaton)], pa.binary())})


def automata(reference: DataFrame, shard_words: int = SHARD_WORDS, most_words: int = MOST_WORDS) -> list[Automaton]:
    """An automaton for each shard of ``reference``; a larger one than ``most_words`` is refused."""
    words = reference.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    if words > most_words:
        raise ValueError(f"the reference has {words} words, more than {most_words}: use substring_dedup")
    shard = F.pmod(F.xxhash64("text"), F.lit(max(1, math.ceil(words / shard_words))))
    dealt = reference.where("text is not null").select(shard.alias("shard"), "text").dropDuplicates(["text"])
    return [pickle.loads(row["automaton"]) for row in dealt.groupBy("shard").applyInArrow(_build, "automaton binary").collect()]


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` without the runs of at least ``window`` words that ``reference`` has; adds ``n_words, n_removed``.

    Words that stay are joined by one blank. Null texts have no words and become empty; null
    texts of the reference are left out; an empty reference removes nothing; repeated rows
    get the same result; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata(reference.select("text"), shard_words, most_words))
    base = docs.drop("n_words", "n_removed")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts, counts, gone = [], [], []
            for text in text_bytes(batch.column("text")):
                words = text.split()
                out = np.zeros(len(words), dtype=bool)
                for automaton in shared.value:
                    out |= spans(automaton.matches(words), window)
                counts.append(len(words))
                gone.append(int(out.sum()))
                texts.append(b" ".join(words[i] for i in np.flatnonzero(~out).tolist()))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    return base.mapInArrow(run, with_fields(base, "n_words long, n_removed long"))
