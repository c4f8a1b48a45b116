"""Quality rules with adaptive thresholds.

Base counts are taken from each whole text by array functions. The verdict then holds a few
rates of a document against fences that come from the data: quantile sketches per (language,
source), merged into one per language and one of all documents, stand in for fixed cutoffs.

A sketch is a histogram with logarithmic bins (relative accuracy ``ACCURACY``): bin counts merge
across tasks and levels by addition and do not depend on order, so reruns agree. The fences of
a group are ``q75 + SPREAD * iqr`` and ``q25 - SPREAD * iqr`` of its own documents, where
the interquartile range counts as the rate's resolution at least. Groups with fewer than ``LEAST_DOCS``
documents use the sketch of their language, and failing that the one of all documents. The fences (one row
per language and source) are joined to the documents, which are then judged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

WINDOW = 8
ACCURACY = 0.02
LEAST_DOCS = 100
SPREAD = 6.0
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Rates of a document and their resolutions.
RATES = {"symbol_rate": 0.02, "dup_line_rate": 0.1, "word_length": 0.3, "upper_rate": 0.03}
_NONE = -1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(words: Column) -> Column:
    """Hashes of all runs of eight words, by doubling: of pairs, of pairs of pairs, of pairs of those."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = _let(hashes, _joined(step))
    return hashes


def _joined(step: int) -> Callable[[Column], Column]:
    def join(h: Column) -> Column:
        left = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))

    return join


def repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order.

    Texts whose windows all differ - nearly all - are told by one distinct count. Otherwise the
    hashes are sorted with their places, and a window repeats if a neighbour equals it. Each
    repeated window adds the words before the next one's start, so a word counts once.
    """

    def starts(p: Column) -> Column:
        at = lambda k: F.get(p, k)["h"]
        same = lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), same), lambda k: F.get(p, k)["i"]))

    def covered(s: Column) -> Column:
        steps = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    count = _let(_let(placed, starts), covered)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(count).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the base counts; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    split = docs.select(
        "doc_id", "lang", "source",
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("__upper"),
        words.alias("__words"),
        lines.alias("__lines"),
    )
    held = split.select(
        "doc_id", "lang", "source", "n_symbols", "__upper",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("__words")).alias("__windows"),
    )
    return held.withColumn("n_repeat_words", repeated_words(F.col("__windows"))).drop("__windows")


def rated(counts: DataFrame) -> DataFrame:
    """Base verdict and the rates that the fences are for (null where there are no words)."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.when(F.col("__n_lines") > 0, F.col("__n_lines")),
        "word_length": F.col("word_chars") / n,
        "upper_rate": F.col("__upper") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
    })


def _bin(rate: Column) -> Column:
    return F.when(rate > 0, F.ceil(F.log(rate) / math.log(_GAMMA)).cast("int")).otherwise(_NONE)


def _value(bin_: Column) -> Column:
    return F.when(bin_ == _NONE, 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), bin_.cast("double")) / (_GAMMA + 1))


def fences(rates: DataFrame) -> DataFrame:
    """``lang, source`` and ``<rate>_low, <rate>_high`` for every group of documents that pass the base rules."""
    long = rates.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _bin(F.col(r)).alias("bin")) for r in RATES])).alias("x")
    )
    bins = long.groupBy("lang", "source", F.col("x.rate").alias("rate"), F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    levels = [bins.withColumn("level", F.lit(2))]
    levels.append(bins.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")).withColumn("level", F.lit(1)))
    levels.append(
        bins.groupBy("rate", "bin").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(0)})
    )
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    group = ["level", "lang", "source", "rate"]
    upto = Window.partitionBy(*group).orderBy("bin")
    total = Window.partitionBy(*group)
    sketch = merged.withColumn("below", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(total))
    quantile = lambda q: _value(F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bin"))))
    found = sketch.groupBy(*group).agg(F.max("total").alias("total"), quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))
    least = F.element_at(F.create_map(*[x for r, v in RATES.items() for x in (F.lit(r), F.lit(v))]), F.col("rate"))
    reach = SPREAD * F.greatest(F.col("q75") - F.col("q25"), least)
    found = found.select(*group, "total", (F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"))
    own, lang, every = (found.where(F.col("level") == k).drop("level").alias(f"l{k}") for k in (2, 1, 0))
    out = own.join(
        lang, F.col("l2.lang").eqNullSafe(F.col("l1.lang")) & (F.col("l2.rate") == F.col("l1.rate")), "left"
    ).join(every, F.col("l2.rate") == F.col("l0.rate"), "left")
    pick = lambda c: F.when(F.col("l2.total") >= LEAST_DOCS, F.col(f"l2.{c}")).when(F.col("l1.total") >= LEAST_DOCS, F.col(f"l1.{c}")).otherwise(F.col(f"l0.{c}"))
    flat = out.select(F.col("l2.lang").alias("__lang"), F.col("l2.source").alias("__source"), F.col("l2.rate").alias("rate"), pick("low").alias("low"), pick("high").alias("high"))
    return flat.groupBy("__lang", "__source").pivot("rate", list(RATES)).agg(F.first("low").alias("low"), F.first("high").alias("high"))


def judge(rates: DataFrame) -> DataFrame:
    """``rates`` with ``kept``: the base rules hold and every rate lies within the fences of the document's group."""
    limits = fences(rates)
    joined = rates.join(limits, rates["lang"].eqNullSafe(limits["__lang"]) & rates["source"].eqNullSafe(limits["__source"]), "left")
    inside = F.lit(True)
    for rate in RATES:
        inside = inside & F.coalesce(F.col(rate).between(F.col(f"{rate}_low"), F.col(f"{rate}_high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("__lang", "__source")


def apply_rules(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row of ``docs`` (``doc_id, text, lang, source`` are read).

    A null text has no words and fails the base rules; null languages and sources are groups of
    their own; repeated rows get the same answer; an empty table gives no rows.
    """
    return judge(saved(rated(counted(docs))))
