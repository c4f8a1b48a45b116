"""Near-duplicate documents, lines and substrings against brute force on hand-made and given texts."""

import collections
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import automaton, line_dedup, mixing, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(60)]


def fixture_texts(seed=3):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    base = words(120)
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1] + ["end"]), None, "", " \t\n ", "a b", "A b", "x " * 60]
    texts += ["\n".join(" ".join(words(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    line = words(12)
    for i in range(8):
        near = list(line)
        near[i % 12] = f"n{i}"
        texts.append(" ".join(words(6)) + "\n" + " ".join(near) + "\n\n" + " ".join(line).upper())
    passage = " ".join(words(30))
    texts += [f"{' '.join(words(5))} {passage} {' '.join(words(5))}" for _ in range(4)]
    texts.append(" ".join(words(20_000)))
    return texts


def table(spark, texts, ids=None):
    ids = ids or [7 * i % 1009 for i in range(len(texts))]
    rows = [(i, t, "x", 1.5) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, fp double").repartition(3)


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    texts = fixture_texts()
    docs = table(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {7 * i % 1009: brute_fingerprint(t) for i, t in enumerate(texts)}
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] > root[a]:
                    root[b], changed = root[a], True
    assert got == {d: (f"{p:016x}", root[d]) for d, p in prints.items()}


@pytest.mark.parametrize("seed", range(3))
def test_links_of_random_fingerprints(spark, seed):
    rng = random.Random(seed)
    values = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            values.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = {(r.a, r.b) for r in simhash.links(df).collect()}
    every = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert edges <= every

    def parts(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {v: find(v) for v in signed}

    assert parts(edges) == parts(every)


def test_simhash_empty_and_nulls(spark):
    assert simhash.near_duplicates(table(spark, ["a"]).limit(0)).count() == 0
    docs = table(spark, ["same words here now", "same words here now", "other text of mine", None], [None, 4, 9, 12])
    kept = {(r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()}
    assert kept == {(None, "same words here now"), (9, "other text of mine"), (12, None)}


def test_simhash_keeps_one_row_of_each_component(spark):
    """Null and repeated ids stand in several components; each component keeps a row of its own."""
    words = [" ".join(random.Random(i).choices(VOCAB, k=40)) for i in range(5)]
    a, b, c, d, e = words
    docs = table(spark, [a, a, b, b, c, d, e, d, d], [None, 3, None, 4, 8, 8, 8, 8, 9])
    kept = [(r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(None, a), (None, b), (8, c), (8, d), (8, e)], key=repr)


def test_simhash_ties_in_other_columns(spark):
    """Of rows equal in id and text the smallest in the other columns stays, whatever the partitions."""
    rows = [(5, "same words here now", x, y, {"k": 1}) for x, y in [("en", 2.0), (None, 9.0), ("de", 1.0), (None, 3.0)]]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y double, m map<string,int>").repartition(n)
        assert [(r.lang, r.y) for r in simhash.deduplicated(docs).collect()] == [(None, 3.0)]


def brute_lines(rows):
    kept, seen = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        out = []
        for line in (text or "").split("\n"):
            tokens = set(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if not tokens or not any(5 * len(tokens & s) >= 4 * len(tokens | s) for s in seen):
                out.append(line)
            if tokens:
                seen.append(tokens)
        kept[doc] = None if text is None else "\n".join(out)
    return kept


def test_lines(spark):
    texts = fixture_texts()
    docs = table(spark, texts)
    cut = line_dedup.remove_near_lines(docs)
    assert cut.columns == ["doc_id", "text", "n_words", "fp", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in cut.collect()} == brute_lines([(7 * i % 1009, t) for i, t in enumerate(texts)])


def test_lines_second_round(spark):
    """A line whose closest partner fails is tried against the others."""
    rng = random.Random(1)
    base = [f"t{i}" for i in range(40)]
    texts = []
    for i in range(60):
        line = list(base)
        for j in rng.sample(range(40), rng.randint(2, 9)):
            line[j] = f"v{i}_{j}"
        texts.append(" ".join(line))
    docs = table(spark, texts, list(range(60)))

    got = {r.doc_id: r.text for r in line_dedup.remove_near_lines(docs).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_lines_large_family(spark):
    """A word of over HOT_ENTRIES lines: near copies, far copies, and a second family under the same rare word."""
    rng = random.Random(2)
    one, two = ([f"{k}{i}" for i in range(30)] for k in "pq")
    texts = []
    for i in range(line_dedup.HOT_ENTRIES + 200):
        line = list(one if i % 3 else two)
        for j in rng.sample(range(30), rng.choice([1, 2, 3, 9])):
            line[j] = f"v{i}_{j}"
        texts.append(" ".join([*line, "rare"]))
    got = {r.doc_id: r.text for r in line_dedup.remove_near_lines(table(spark, texts, list(range(len(texts))))).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_lines_of_a_hot_word_with_one_late_partner(spark):
    """Lines of a hot word whose few candidates among the first lines fail are tried against all."""
    rng = random.Random(11)
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(["rare", *rng.sample(words, 9)]) for _ in range(line_dedup.HOT_ENTRIES + 300)]
    for i in range(0, 200, 5):  # near copies of lines in the middle
        line = texts[400 + i].split()
        line[rng.randrange(1, 10)] = f"n{i}"
        texts.append(" ".join(line))
    got = {r.doc_id: r.text for r in line_dedup.remove_near_lines(table(spark, texts, list(range(len(texts))))).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert sum(t == "" for t in got.values()) >= 40


def test_clashing_names(spark):
    """Columns named like the operators' own working columns come through as they are."""
    names = ["doc", "crc", "lines", "__doc", "__crc", "__id", "__text", "__key", "__rows", "bucket", "n_lines_"]
    long_text = " ".join(VOCAB)
    rows = [(i, long_text if i < 2 else f"{long_text} {i}", "en", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for run in (line_dedup.remove_near_lines, substring_dedup.remove_repeats, simhash.deduplicated, mixing.mixed_documents):
        found = run(docs)
        assert found.columns[: len(docs.columns)] == docs.columns
        got = found.collect()
        assert got
        for r in got:
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]


def test_lines_repeated_rows_and_empty(spark):
    docs = table(spark, ["one two three", "one two three", "one two three"], [5, 5, 6])
    got = sorted((r.doc_id, r.text) for r in line_dedup.remove_near_lines(docs).collect())
    assert got == [(5, "one two three"), (5, "one two three"), (6, "")]
    assert line_dedup.remove_near_lines(docs.limit(0)).count() == 0


def brute_windows(rows, window=20):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if tuple(words[i : i + window]) in seen:
                gone.update(range(i, i + window))
            seen[tuple(words[i : i + window])] = 1
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_substrings(spark):
    texts = fixture_texts()
    cut = substring_dedup.remove_repeats(table(spark, texts).drop("n_words"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in cut.collect()}
    assert got == brute_windows([(7 * i % 1009, t) for i, t in enumerate(texts)])


def test_substrings_of_repetitive_text(spark):
    texts = ["a b c " * 400, "c a b " * 300, "a " * 700, "z", " ".join(VOCAB)]
    docs = table(spark, texts, [3, 1, 2, 8, 9])
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_windows(list(zip([3, 1, 2, 8, 9], texts, strict=True)))


def brute_known(words, shards, window):
    """Words in a run of at least ``window`` words that one of the shards' texts has."""
    known = {tuple(ref[i : i + window]) for ref in shards for i in range(len(ref) - window + 1)}
    gone = set()
    for i in range(len(words) - window + 1):
        if tuple(words[i : i + window]) in known:
            gone.update(range(i, i + window))
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_automaton_matches(seed):
    rng = random.Random(seed)
    refs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))] for _ in range(6)]
    words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(300)] + refs[0]
    runs = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    longest = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(words))]
    assert automaton.Automaton(refs).matches(words).tolist() == longest


def test_known_passages(spark):
    rng = random.Random(9)
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    refs = [words(40) for _ in range(12)]
    texts = [" ".join(words(8) + r[5 : 5 + n] + words(8)) for r, n in zip(refs, range(15, 27), strict=True)] + [None, "", " ".join(refs[3])]
    docs = table(spark, texts, list(range(len(texts))))
    reference = spark.createDataFrame([(" ".join(r),) for r in refs] + [(None,), (" ".join(refs[0]),)], "text string")
    for shard_words in (50_000, 60):
        cut = automaton.remove_known(docs, reference, shard_words=shard_words)
        assert cut.columns == ["doc_id", "text", "fp", "n_words", "n_removed"]
        for r in cut.collect():
            own = WORD.findall(texts[r.doc_id] or "")
            gone = brute_known(own, refs, 20)
            assert (r.n_words, r.n_removed, r.text) == (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    assert {r.n_removed for r in automaton.remove_known(docs, reference.limit(0)).collect()} == {0}
    assert automaton.remove_known(docs.limit(0), reference).count() == 0
    with pytest.raises(ValueError, match="substring_dedup"):
        automaton.automata(reference, most_words=100)


def test_substrings_repeated_rows_and_empty(spark):
    text = " ".join(VOCAB[:30])
    docs = table(spark, [text, text, text, "b " + text], [5, 5, 6, 5])
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(5, 0), (5, 0), (5, 30), (6, 30)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert collections.Counter(r.doc_id for r in substring_dedup.remove_repeats(docs).collect()) == {5: 3, 6: 1}


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_substrings_of_one_id_in_order_of_start(spark, parts):
    """Of rows that share an id the window that starts earlier stays, however the rows are dealt."""
    run = " ".join(VOCAB[:20])
    docs = table(spark, [f"x y z {run}", run, f"x {run}"], [5, 5, 5]).repartition(parts)
    got = {r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {"x y z", run, "x"}


def test_substrings_hot_anchor(spark, monkeypatch):
    """Windows of a common five-word run meet by their own words when the run is hot."""
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 8)  # read on the driver
    rng = random.Random(5)
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    hot, near = words(5), words(12)
    texts = [" ".join([*words(14), *hot, *(near if i % 2 else []), *words(14), *(hot if i % 3 else []), *near, *hot]) for i in range(300)]
    texts += texts[:5]
    docs = table(spark, texts, list(range(len(texts))))
    _, found = substring_dedup._hot_anchors(docs.select(F.col("doc_id").alias("doc"), "text"), 20)
    assert len(found)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs.drop("n_words")).collect()}
    assert got == brute_windows(list(enumerate(texts)))
