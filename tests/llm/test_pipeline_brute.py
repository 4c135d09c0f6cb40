"""run() against plain Python versions of all five stages, on a fixture with planted near lines, near copies, benchmark passages, nulls, repeats and clashing names."""

import hashlib
import random

import corpus_pipeline
from stratamesh.llm import bpe, rules
from test_brute_force import CLASH, brute_join, brute_lines, words
from test_operators import brute_contamination


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(900)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = [(i, line(30)) for i in range(5)]
    footer = line(14)
    rows = [(i, "\n".join([line(40), line(30), footer])) for i in range(30)]
    rows += [(40 + i, rows[i][1]) for i in range(4)]  # exact copies
    rows += [(50 + i, rows[i][1].replace(rows[i][1].split()[7], "other", 1)) for i in range(4)]  # near copies
    rows += [(60 + i, line(40) + "\n" + bench[i][1]) for i in range(3)] + [(70, line(600) + "\n" + bench[4][1][:60])]
    rows += [(80, None), (81, ""), (82, "### " * 80), (83, "few words"), (None, "\n".join([line(35), line(35)])), (3, "\n".join([line(45), footer]))]
    rows += [rows[10], (None, rows[-2][1])]
    near = line(60).split()
    rows += [(90, " ".join(near)), (91, " ".join([*near[:30], "changed", *near[31:]]))]
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "w", "o", "l", "k", 2) for d, t in rows], CLASH).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], CLASH).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")

    kept = [(x.doc_id, x.text) for x in rules.assess(spark.read.parquet(f"{folder}/documents.parquet")).filter("_q.kept").collect()]  # its counts and base rules have a test of their own
    assert all(len(words(t)) >= 50 for _, t in kept) and len(kept) >= len(rows) - 6
    gone = brute_lines(kept)
    texts = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if gone.get((n, i), (n, i)) == (n, i))) for n, (d, t) in enumerate(kept)]
    texts = [(d, t) for d, t in texts if t.strip()]
    _, tops = brute_join(texts, 5, 80)
    first = {}
    for i, top in sorted(tops.items(), key=lambda x: (texts[x[0]][0] is None, texts[x[0]][0] or 0, x[0])):
        first.setdefault(top, i)
    sets = [len(words(t)) for _, t in texts]
    texts = [x for i, x in enumerate(texts) if first[tops[i]] == i or not sets[i]]
    judged = brute_contamination(texts, bench)
    dirty = {d for d, n, hit, _ in judged if hit and 20 * hit >= n}
    assert dirty == {60, 61, 62}
    expected = [(d, t) for d, t in texts if d not in dirty]
    t = bpe.tokenizer(bpe.vocabulary())
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256) for x in out) == sorted((str(d), len(t.encode(x)), hashlib.sha256(" ".join(map(str, t.encode(x))).encode()).hexdigest()) for d, x in expected)
    assert not {40, 41, 42, 43, 50, 51, 52, 53, 91} & {x.doc_id for x in out} and all(x.n_tokens > 0 for x in out)
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
