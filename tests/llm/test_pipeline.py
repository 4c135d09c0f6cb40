import corpus_pipeline
from stratamesh.llm.storage import stored


def test_stages(spark, tmp_path):
    good = " ".join(f"word{i * 37 % 211}" for i in range(90))
    rows = [(1, good), (2, good + "\nextra"), (3, "### " * 200), (4, None), (5, " ".join(f"other{i * 53 % 307}" for i in range(120)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"other{i * 53 % 307}" for i in range(40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)), "t")
        ids.append(sorted(r.doc_id for r in now.collect()))
        assert name == corpus_pipeline.STAGES[-1][0] or now.columns == docs.columns
    assert ids[0] == [1, 2, 5] and ids[3] == [1, 2] and ids[4] == [1, 2]
    assert {r.doc_id: r.n_tokens > 0 for r in now.collect()} == {1: True, 2: True}


def test_near_copies_of_five_words_and_eighty_percent_go(spark, tmp_path):
    """One block differs: 5-word similarity from 0.80, 4-word similarity below 0.85; another pair is below both."""
    own = lambda i, n: [f"d{i}x{j}" for j in range(n)]
    texts = {1: own(1, 100), 2: own(1, 60) + own(2, 6) + own(1, 100)[66:], 3: own(3, 100), 4: own(3, 60) + own(4, 12) + own(3, 100)[72:]}
    grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    similar = lambda a, b, k: len(grams(texts[a], k) & grams(texts[b], k)) / len(grams(texts[a], k) | grams(texts[b], k))
    assert similar(1, 2, 5) >= 0.8 and similar(1, 2, 4) < 0.85 and similar(3, 4, 5) < 0.8
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3, 4]
