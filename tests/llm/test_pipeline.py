"""The pipeline on a table whose right outcome is known."""

import random

import corpus_pipeline
from waymark.llm.common import shared_path


def test_stages(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(["the and of"] + [f"w{rng.randrange(50_000)}" for _ in range(n)])
    item = words(25)
    clean = {i: words(80) for i in range(20)}
    near = clean[3].split()
    near[40] = "changed"
    shared = "This line stands in more than one document of this corpus, word for word."
    table = [*clean.items(), (30, clean[5]), (31, " ".join(near)), (32, words(60) + " " + item), (33, "too short"), (34, "ab! " * 90), (35, words(80) + "\n" + shared), (36, words(80) + "\n" + shared)]
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    folder = shared_path(spark, "pipe")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, docs = [], d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == d.columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, lines, joined, clean_of_benchmark = kept
    assert set(quality) == set(dict(table)) - {33, 34}
    assert set(lines) == set(quality) - {30} and shared in lines[35] and shared not in lines[36]
    assert set(joined) == set(lines) - {31}
    assert set(clean_of_benchmark) == set(joined) - {32}
    mix = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in mix} <= set(clean_of_benchmark) and all(1 <= r["copies"] <= 3 for r in mix)
    total = sum(len(t.split()) for t in clean_of_benchmark.values())
    assert abs(sum(r["taken"] for r in mix) - total) < 0.1 * total


def test_stage_keeps_nameless(spark):
    """Rows of null doc_id stay if no document with an id resembles them, one of each group."""
    rng = random.Random(13)
    a, b, c = (" ".join(f"w{rng.randrange(50_000)}" for _ in range(80)) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    table = [(1, a), (None, a), (None, near(a)), (None, b), (None, c), (None, c), (None, near(c))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.ngram_join(spark, d, "")
    assert out.columns == d.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == 3 and (1, a) in got and (None, b) in got and {t for _, t in got} - {a, b} <= {c, near(c)}


def test_run_on_odd_tables(spark):
    """Nulls, blanks and repeats pass through run(); an empty table gives an empty mix."""
    rng = random.Random(14)
    good = "the and of " + " ".join(f"w{rng.randrange(50_000)}" for _ in range(80))
    table = [(1, None, None), (None, good, "s"), (2, "", "s"), (3, good, None), (3, good, None), (4, " \n\t", "s")]
    d = spark.createDataFrame([(i, t, "en", s, len(t or ""), 7) for i, t, s in table], "doc_id long, text string, lang string, source string, n_chars long, own int")
    for docs in (d, d.limit(0)):
        folder = shared_path(spark, "odd")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "a benchmark item of some words that nothing holds")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        mix = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in mix} == ({3} if docs is d else set())
