"""The pipeline's stages on the smallest documents: each does its work on all that the stage before kept."""

import corpus_pipeline
from framelake.llm import langid
from tests.conftest import SMALL

from .test_dedup import brute_fingerprint, brute_lines


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "mix", "pack"]
    stages = dict(corpus_pipeline.STAGES)

    first = stages["language"](spark, docs, SMALL).cache()
    assert first.columns == docs.columns
    rejected = langid.identify_documents(docs).where("lang_pred = 'und' or score < 0.5").count()
    assert first.count() == docs.count() - rejected

    second = stages["lines"](spark, first, SMALL).cache()
    got = {r.doc_id: (r.text, r.n_chars) for r in second.collect()}
    expected = brute_lines([(r.doc_id, r.text) for r in first.collect()])
    assert got == {d: (t, len(t)) for d, t in expected.items()}

    third = stages["near_duplicates"](spark, second, SMALL).cache()
    prints = {d: brute_fingerprint(t) for d, (t, _) in got.items()}
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] > root[a]:
                    root[b], changed = root[a], True
    assert {r.doc_id for r in third.collect()} == {d for d in root if root[d] == d}

    fourth = stages["mix"](spark, third, SMALL).cache()
    assert fourth.columns == docs.columns
    last = stages["pack"](spark, fourth, SMALL)
    totals = {}
    for r in last.collect():
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length / r.doc_tokens
    copies = {}
    for r in fourth.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert {d: round(x) for d, x in totals.items()} == copies


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def odd_documents(spark):
    """Null and repeated ids, null, empty and very long texts, equal rows, and columns named like working columns."""
    lines = [f"the river and the mountain number {i} are of the valley {i} and the sea" for i in range(400)]
    english = lambda i: " ".join(lines[(i * 3 + j) % 400] for j in range(4))
    rows = [(i, english(i), "en", "web" if i % 3 else None, 0) for i in range(60)]
    rows += [(None, english(80), "en", "web", 0), (None, english(90), None, "web", 0), (7, english(91), "en", "web", 0), (7, english(7), "en", "web", 0)]
    rows += [(7, english(7), "en", "web", 0), (200, None, None, None, None), (201, "", "en", "web", 0), (202, "12 34", None, "web", 5), (203, "\n".join(lines * 20), "en", "web", 0)]
    rows = [(*r, f"key{i}", f"id{i}", f"doc{i}") for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key string, __id string, doc string").repartition(3)


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        found = stage(spark, docs, SMALL)
        if name != "pack":
            assert found.columns == docs.columns
        got = found.collect()
        tags = [r.doc for r in got] if name != "pack" else []
        if name == "language":
            assert sorted(tags) == sorted(r.doc for r in rows if r.doc_id not in (200, 201, 202))
        elif name == "lines":
            assert sorted(tags) == sorted(r.doc for r in rows)
            assert all((r.n_chars is None) == (r.text is None) and (r.text is None or r.n_chars == len(r.text)) for r in got)
            equal = [r.text for r in got if r.doc_id == 7 and r["__key"] in ("key63", "key64")]
            assert len(equal) == 2 and equal[0] == equal[1]
        elif name == "near_duplicates":
            prints = {r.doc: brute_fingerprint(r.text) for r in rows}
            root = {d: d for d in prints}
            changed = True
            while changed:
                changed = False
                for a in prints:
                    for b in prints:
                        if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] > root[a]:
                            root[b], changed = root[a], True
            assert sorted(root[t] for t in tags) == sorted(set(root.values()))
        elif name == "mix":
            assert set(tags) <= {r.doc for r in rows if r.text and r.text.strip()} and len(tags) > 40
        assert stage(spark, docs.limit(0), SMALL).count() == 0
