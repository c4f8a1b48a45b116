"""Language identification by word-first backoff.

Training counts whole words and character n-grams (word bounded, ``^`` and ``$``)
per language over a bounded sample of labelled documents. A known word scores its
smoothed log frequency in each language; an unseen word backs off to its character
n-grams of the longest length at which at least one of them is known, then to shorter
ones. A document's score is the softmax of its mean score per word, weighted by the
square root of its words, so that it stays between 0 and 1 for any length.

The model holds every word and n-gram that the sample has ``least_count`` times or more, so its size follows the
sample, whose bound is a parameter; it travels to the tasks as one broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix, release, rows_of, saved, with_fields
from .words import blocks, hash_spans

#: Bound of the training sample: expected different documents per language, picked by the hash of id and text. Copies
#: count once, so neither null nor repeated ids nor a frequent text decide what is in it.
SAMPLE_DOCS = 1500
#: What occurs less often in the whole sample says nothing about a language (parameter ``least_count``).
LEAST_COUNT = 3
#: n-gram lengths, longest first.
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Letters with the marks that combine with them.
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Texts whose letters beyond a-z lie between U+00C0 and U+024F and which hold no marks (nor a letter that gets one in lower case): all of their
#: words can be told by their bytes.
_PLAIN = re.compile("[\x00-\x7f\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\u012f\u0131-\u024f\u2000-\u206f]*")
_MEMO = 400_000


@dataclass
class Model:
    """Log frequencies: row i of the matrices belongs to the word or n-gram with number i."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def grams_of(word: str, n: int) -> list[str]:
    bounded = f"^{word}$"
    return [bounded[i : i + n] for i in range(len(bounded) - n + 1)]


def letter_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in the bytes of plain texts in lower case: a-z, and two bytes led by C3 to C9 but the signs U+00D7 and U+00F7."""
    lead = (buf >= 0xC3) & (buf <= 0xC9)
    sign = np.zeros(len(buf), dtype=bool)
    sign[:-1] = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
    lead &= ~sign
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ((buf >= 0x61) & (buf <= 0x7A)) | lead
    inside[2:-1] |= lead[:-1]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(_WORDS.findall(text.lower()))
        for lang, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "token", "n"]
            )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "token", "n")), strict=True):
            for order in ORDERS:
                for gram in grams_of(word, order):
                    counts[lang, gram] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["lang", "token", "n"],
        )


def _logs(counts: DataFrame, n_langs: int, add: float, least_count: int) -> tuple[dict[str, int], np.ndarray]:
    """The tokens of at least ``least_count`` occurrences and their smoothed log frequency per language."""
    listed = counts.groupBy("token").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("total"))
    wide = listed.where(F.col("total") >= least_count).select("token", F.transform("by", lambda x: x["lang"]).alias("lang"), F.transform("by", lambda x: x["n"]).alias("n"))
    found = wide.toArrow().combine_chunks()
    values = np.zeros((found.num_rows, n_langs))
    if found.num_rows:
        lang, n = (found.column(c).combine_chunks() for c in ("lang", "n"))
        values[lang.value_parent_indices().to_numpy(), lang.flatten().to_numpy()] = n.flatten().to_numpy()
    logs = np.log(values + add) - np.log(values.sum(axis=0) + add * (len(values) + 1))
    return {t: i for i, t in enumerate(found.column("token").to_pylist())}, logs.astype(np.float32)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, least_count: int = LEAST_COUNT) -> Model:
    """A model from rows with ``doc_id, lang, text``; counts are made in the tasks, the driver gets the kept tokens and one row a language.

    Rows with a null language or text are left out; a language may be any string. Rows that agree in id, text and language count
    once; ids may be null or repeat. Without any labelled row the model knows no language and every prediction is ``und``.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11)).alias("place"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    number = {lang: i for i, lang in enumerate(langs)}
    span = 1 << 40
    shares = [(r["lang"], number[r["lang"]], span if r["n"] <= sample_docs else int(span * sample_docs / r["n"])) for r in sizes]
    share = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, number int, share long"))
    picked = known.join(share, "lang").where(F.pmod("place", F.lit(span)) < F.col("share"))
    sample = picked.groupBy("number", "place").agg(F.min("text").alias("text")).select(F.col("number").alias("lang"), "text")
    schema = "lang int, token string, n long"
    words = saved(sample.mapInArrow(_count_words, schema).groupBy("lang", "token").agg(F.sum("n").alias("n")))
    grams = words.mapInArrow(_count_grams, schema).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    word_index, word_logs = _logs(words, len(langs), 0.1, least_count)
    gram_index, gram_logs = _logs(grams, len(langs), 0.1, least_count)
    release(words)
    return Model(langs, word_index, word_logs, gram_index, gram_logs)


class Scorer:
    """Scores words with a bounded memo of those that had to back off.

    ``predict`` scores one text word by word. ``predict_all`` gives the same for many at once: words of plain texts are hashed in blocks and looked up
    among the sorted hashes of the model's words; only those that aren't there become strings again, once a block.
    """

    def __init__(self, model: Model):
        self.model = model
        names = [w.encode() for w in model.words]
        size = np.fromiter(map(len, names), np.int64, len(names))
        start = np.cumsum(size) - size
        h = hash_spans(np.frombuffer(b"".join(names), np.uint8), start, start + size) if names else np.zeros(0, np.uint64)
        by = np.argsort(h)
        self.hashes, self.known = h[by], model.word_logs[list(model.words.values())][by] if names else np.zeros((0, len(model.langs)), np.float32)
        self.memo: dict[int, np.ndarray] = {}
        self.rows = np.zeros((len(model.words) + _MEMO, len(model.langs)), np.float32)
        self.rows[: len(model.words)] = model.word_logs
        self.flat = np.zeros(len(model.langs), np.float32)
        self._reset()

    def _reset(self) -> None:
        self.index = dict(self.model.words)

    def backoff(self, word: str) -> np.ndarray:
        """The mean log frequency of the word's n-grams, at the longest length of which at least half are known."""
        for n in ORDERS:
            every = grams_of(word, n)
            known = [i for g in every if (i := self.model.grams.get(g)) is not None]
            if known and (2 * len(known) >= len(every) or n == ORDERS[-1]):
                return self.model.gram_logs[known].mean(axis=0)
        return self.flat

    def _unknown(self, h: int, word: bytes) -> np.ndarray:
        found = self.memo.get(h)
        if found is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            found = self.memo[h] = self.backoff(word.decode())
        return found

    def _block(self, texts: list[bytes]) -> list[tuple[str, float]]:
        buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        start, end = letter_spans(buf)
        h = hash_spans(buf, start, end)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        first = np.searchsorted(start, begins)
        row = np.searchsorted(self.hashes, h)
        there = np.zeros(len(h), dtype=bool)
        if len(self.hashes):
            there = self.hashes[np.minimum(row, len(self.hashes) - 1)] == h
        table = self.known
        if not there.all():
            away = np.flatnonzero(~there)
            each, at, place = np.unique(h[away], return_index=True, return_inverse=True)
            spans = zip(each.tolist(), start[away[at]].tolist(), end[away[at]].tolist(), strict=True)
            table = np.concatenate([table, np.stack([self._unknown(x, buf[a:b].tobytes()) for x, a, b in spans])])
            row[away] = len(self.known) + place
        n = np.diff(first)
        some = np.flatnonzero(n)
        total = np.add.reduceat(table[row].astype(float), first[:-1][some]) if len(some) else np.zeros((0, len(self.model.langs)))
        score = total / np.sqrt(n[some])[:, None]
        best = score.argmax(axis=1)
        sure = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        out = [(UNKNOWN, 0.0)] * len(texts)
        for i, b, p in zip(some.tolist(), best.tolist(), sure.tolist(), strict=True):
            out[i] = (self.model.langs[b], p)
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.model.langs:
            return out
        plain = [i for i, t in enumerate(texts) if t and _PLAIN.fullmatch(t)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = self.predict(texts[i])
        low = [texts[i].lower().encode() for i in plain]
        for a, b in blocks(low):
            for i, found in zip(plain[a:b], self._block(low[a:b]), strict=True):
                out[i] = found
        return out

    def _number(self, word: str) -> int:
        at = self.index.get(word)
        if at is None:
            at = self.index[word] = len(self.index)
            self.rows[at] = self.backoff(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORDS.findall(text.lower()) if text else []
        if not self.model.langs or not words:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            if len(self.index) + len(part) > len(self.rows):
                self._reset()
            numbers = list(map(self.index.get, part))
            if None in numbers:
                numbers = [self._number(w) if i is None else i for w, i in zip(part, numbers, strict=True)]
            total += self.rows[numbers].sum(axis=0, dtype=float)
        score = total / np.sqrt(len(words))
        best = int(np.argmax(score))
        return self.model.langs[best], float(1 / np.exp(score - score[best]).sum())


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` (0 to 1); only ``text`` is read.

    A null text or one without letters is ``und`` with score 0. Repeated rows get the
    same answer; other columns pass through, but for an older ``lang_pred`` or ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in rows_of(batches):
            found = scorer.predict_all(batch.column("text").to_pylist())
            kept = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                [*kept, lang, score],
            )

    base = docs.drop(lang, score)
    schema = with_fields(base, f"{lang} string, {score} double")
    return base.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of the documents that training must not see; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: trained on the documents that aren't held out, applied to all."""
    model = train(docs.where(~held_out()).select("doc_id", "lang", "text"), sample_docs, least_count)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, sample_docs: int = SAMPLE_DOCS, least_count: int = LEAST_COUNT) -> DataFrame:
    """The documents whose language is found with a score of at least ``least``; the columns of ``docs``."""
    model = train(docs.where(~held_out()).select("doc_id", "lang", "text"), sample_docs, least_count)
    p = prefix(docs)
    found = identify(docs, model, f"{p}lang", f"{p}score")
    return found.where((F.col(f"{p}lang") != UNKNOWN) & (F.col(f"{p}score") >= least)).select(*docs.columns)
