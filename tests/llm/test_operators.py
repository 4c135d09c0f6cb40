"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratamesh.llm import blocks, bpe, components, identifiers, lines, ngramjoin, paragraphs, ranking, rules, warczip, winnowing
from stratamesh.llm.storage import fresh

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i) % 400] for i in range(n))


BASE = text(1, 120)
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("w5 ", "x5 ", 1), "en", "a"),
    (4, text(2, 150) + "\n" + BASE, "en", "a"),
    (5, None, None, None),
    (6, "", "de", "b"),
    (7, text(3, 3), "de", "b"),
    (8, text(3, 3), "de", "b"),
    (9, "spam " * 3000, "de", "b"),
    (9, "spam " * 3000, "de", "b"),
    (10, text(4, 300) + " a.b@c.org 10.0.0.1 x 4111 1111 1111 1111 +49 (30) 123456", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "clash") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_blocks(spark):
    tree = blocks.fit()
    page = "<nav><a href=x>Home</a></nav><article><h1>A &amp; b</h1><p>One\n two<br>three<p>Four<div class='comments'>No</div></article><footer>(c)</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.text, r.n_chars) for r in blocks.extract(df, tree).collect()}
    assert got == {(1, "A & b\nOne two three\nFour", 24), (2, "", 0), (3, "", 0)}
    assert all(blocks.decide(tree, r) == r[-1] for r in blocks.LABELLED)


def test_archives(spark):
    rows = [(1, "u", "a" * 50), (2, "u", "a" * 50), (9, None, "a" * 50), (3, "x", None), (4, "x", ""), (None, "n", "ü")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for zip64 in (False, True):
        for limit in (100, 0):
            m = warczip.write_archives(df, fresh(spark, "t"), zip64=zip64, share_limit=limit, member_bytes=100, archive_bytes=300)
            got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)) for r in warczip.read_records(m).collect()}
            assert got == {1: ("revisit", 9, 50, b""), 2: ("revisit", 9, 50, b""), 9: ("response", None, 50, b"a" * 50), 3: ("revisit", 4, 0, b""), 4: ("response", None, 0, b""), None: ("response", None, 2, "ü".encode())}


def test_rules(docs, none):
    for r in rules.assess(docs).collect():
        w = words(r.text)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r._q.n_words, r._q.word_chars, r._q.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r._q.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert rules.filtered(docs).columns == docs.columns
    assert rules.assess(none).count() == 0
    shared = {(r.doc_id, r._q.kept) for r in rules.assess(docs).collect()}
    assert shared == {(r.doc_id, r._q.kept) for r in rules.assess(docs, share_limit=0).collect()}


def brute_contamination(rows, bench):
    """(doc_id, n_words, n_hit, item ids) of every row, from strings alone."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in rows:
        w, hit, items = split(t), set(), set()
        for item, text_of in bench:
            b = split(text_of)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            places = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams] if n else []
            hit |= {i + j for i in places for j in range(n)}
            items |= {item} if places and item is not None else set()
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def test_winnowing_equals_brute_force_in_both_ways(spark, docs, none):
    """Nulls, repeated rows and ids, runs of one word on both sides, items of less than a window, items without an id."""
    items = [(1, " ".join(words(BASE)[20:50])), (1, text(2, 40)), (2, " ".join(words(text(3, 3)))), (3, None), (4, "spam " * 40), (4, "spam " * 13), (None, text(4, 60)), (5, "Spam"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")]
    rows = [(r[0], r[1]) for r in ROWS] + [(None, BASE), (None, "spam spam"), (None, None), (9, BASE + " " + "spam " * 15)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, row string, own long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contamination(rows, items)
    for limit in (10**6, 0):
        found = winnowing.contamination(df, bench, share_limit=limit).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found], key=str) == expected
        assert all(sum(x.b - x.a for x in r.ranges) == r.n_hit for r in found)
        kept = winnowing.decontaminated(df, bench, share_limit=limit, removed_limit=limit)
        assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, n, hit, _ in expected if not (hit and 20 * hit >= n))
        assert winnowing.contamination(none, bench, share_limit=limit).count() == 0
    named = {r.doc_id: r for r in winnowing.verdict(winnowing.contamination(docs, bench)).collect()}
    assert named[9].items_sha256 == hashlib.sha256(b"4,5").hexdigest() and named[5].n_words == 0 and not named[5].contaminated
    assert not any(r.n_hit for r in winnowing.contamination(docs, bench.limit(0)).collect())


def test_bpe_matches_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary()
    own, theirs = bpe.tokenizer(path), tokenizers.Tokenizer.from_file(path)
    samples = [r[1] or "" for r in ROWS] + ["It's <|endoftext|>x", "aaaa rrrr 123 ½", "ΑΣ É日本", "!" * 500, "\x85a\x1c"]
    for s in samples:
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids and own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs, path), path).filter("doc_id = 7").first().text
    assert back == theirs.decode(theirs.encode(text(3, 3)).ids, skip_special_tokens=False)


def test_lines(spark, none):
    base = "the quick brown fox jumps over the lazy dog and runs away from it all day long until night falls over the hills"
    df = spark.createDataFrame([(1, base + "\n\nother line"), (2, base.replace("lazy", "lame")), (3, base.upper()), (4, None), (5, "  \nother line ")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in lines.repeated(df).collect()}
    assert got == {(1, 0): (1, 0, True), (2, 0): (1, 0, False), (3, 0): (1, 0, False), (1, 2): (1, 2, True), (5, 1): (1, 2, False)}
    out = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    assert out == {1: base + "\n\nother line", 2: "", 3: "", 4: None, 5: "  "}
    assert lines.repeated(none).count() == 0


def test_lines_without_spaces(spark):
    """Near lines of one to three long tokens, with an edit at every place, and http and https."""
    names = [hashlib.sha256(str(i).encode()).hexdigest() + hashlib.sha256(str(-i - 1).encode()).hexdigest()[:12] for i in range(72)]
    grams = lambda t: {t[j : j + 5] for j in range(len(t) - 4)}
    pairs = [(f"http://www.{n[:55]}/{i}", f"https://www.{n[:55]}/{i}") for i, n in enumerate(names[:24])]
    for i, n in enumerate(names):
        t = n if i % 3 == 0 else n[:40] + " " + n[40:] if i % 3 == 1 else n[:25] + " " + n[25:50] + " " + n[50:]
        pairs.append((t, t[:i] + "#" + t[i + 1 :]))
    assert all(len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for a, b in pairs)
    df = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in lines.repeated(df).collect()}
    assert sum(got.get(2 * i + 1) == 2 * i for i in range(len(pairs))) >= 0.98 * len(pairs)
    assert all(first == d - d % 2 for d, first in got.items())


def test_ranking(spark, none):
    good, bad = [(i, text(i, 80) + ".", 1) for i in range(60)], [(100 + i, "### ".join(text(i, 60).split()), 0) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = ranking.train(df, df.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in ranking.score(df.select("doc_id", "text").unionByName(spark.createDataFrame([(999, None)], "doc_id long, text string")), model).collect()}
    assert all((got[i] >= 0.3) == bool(q) for i, _, q in good + bad) and 0 <= got[999] <= 1
    flat = ranking.train(df.limit(0), df.select("doc_id", "quality").limit(0))
    assert flat.score(ranking.np.zeros((1, ranking.FEATURES)))[0] == 0.5


def test_paragraphs(docs, none):
    got = {(r.doc_id, r.start, r.removed) for r in paragraphs.clusters(docs).collect()}
    second = len(text(2, 150)) + 1
    assert {(1, 0, False), (2, 0, True), (3, 0, True), (4, second, True)} <= got
    assert not {d for d, _, _ in got} & {5, 6, 7, 10}
    assert paragraphs.clusters(none).count() == 0


def test_passages_of_fifty_words_are_found_anywhere(spark):
    """Runs of 50 words without sentence ends, in long paragraphs, in short lines, after the first one's own row, at the borders of texts; 49 words are none."""
    own = lambda i, n: [f"d{i}x{j}" for j in range(n)]
    shared = [[f"p{k}y{j}" for j in range(60)] for k in range(6)]
    texts = {1: own(1, 40) + shared[0][:50] + own(2, 33), 2: own(3, 7) + shared[0][:50] + own(4, 90)}
    texts |= {3: shared[1] + own(5, 70), 4: own(6, 31) + shared[1], 5: own(7, 20) + shared[2][:49] + own(8, 20), 6: own(9, 30) + shared[2][:49] + own(10, 30)}
    texts |= {9: own(11, 5) + shared[4] + own(12, 10) + shared[4], 10: own(13, 90)}
    texts |= {11: own(14, 9) + shared[5][:25] + own(15, 30), 12: own(16, 9) + shared[5] + own(17, 9), 13: own(18, 9) + shared[5][:55] + own(19, 9)}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    broken = "\n".join(" ".join(shared[3][i : i + 6]) for i in range(0, 60, 6))
    rows += [(7, " ".join(own(20, 30) + shared[3])), (8, " ".join(own(21, 30)) + "\n" + broken), (14, "spam " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.removed): r for r in paragraphs.spans(df).collect()}
    place = lambda i, n: len(" ".join(texts[i][:n])) + (n > 0)
    expected = {(1, place(1, 40), False): 50, (2, place(2, 7), True): 50, (3, 0, False): 60, (4, place(4, 31), True): 60, (9, place(9, 5), False): 60, (9, place(9, 75), True): 60}
    expected |= {(12, place(12, 9), False): 55, (13, place(13, 9), True): 55, (7, len(" ".join(own(20, 30))) + 1, False): 60, (8, len(" ".join(own(21, 30))) + 1, True): 60}
    expected |= {(14, 0, False): 99, (14, 250, True): 250}
    assert {k: r.n_words for k, r in got.items()} == expected
    assert got[4, place(4, 31), True].keep == (3, 0) and got[8, len(" ".join(own(21, 30))) + 1, True].end == len(" ".join(own(21, 30))) + 1 + len(broken)
    reported = {(r.doc_id, r.start, r.removed) for r in paragraphs.clusters(df).collect()}
    assert set(expected) <= reported


def test_ngram_join(docs, none):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.components(docs).collect())
    named = {d: c for d, _, c in got}
    assert named == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10} and len(got) == len(ROWS)
    assert dict((d, n) for d, n, _ in got)[5] == 0 and ngramjoin.components(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in components.connected(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components.connected(edges.limit(0)).count() == 0


def test_large_groups_lose_no_link(spark):
    """A chain of items in one group, each similar only to its neighbours."""
    items = [(i, list(range(i, i + 20))) for i in range(60)]
    feats = spark.createDataFrame(items, "item long, tokens array<long>")
    members = feats.select(F.lit(1).alias("key"), "item", F.lit(0).cast("long").alias("weight"))
    links = components.verified_links(members, lambda ids: feats.join(ids, "item"), 90)
    assert {r.component for r in components.connected(links).collect()} == {0}


def test_identifiers(spark, docs, none):
    got = {r.doc_id: r for r in identifiers.spans(docs).collect()}
    at = len(text(4, 300)) + 1
    assert [tuple(x) for x in got[10].base] == [(0, at, at + 9), (1, at + 10, at + 18), (2, at + 21, at + 40), (3, at + 41, at + 56)]
    assert got[5].base == [] and identifiers.spans(none).count() == 0
    seeds = [(i, f"call me at +49 30 {100000 + i} today") for i in range(8)] + [(99, "call me at 030-123 today")]
    more = [(100 + i, f"mail to user{i}@example.org now") for i in range(8)] + [(199, "mail to user9@localhost now")]
    found = {r.doc_id: [tuple(x) for x in r["all"]] for r in identifiers.spans(spark.createDataFrame(seeds + more, "doc_id long, text string")).collect()}
    assert len(found[3]) == 1 and len(found[103]) == 1


def test_identifiers_of_unseen_shape_are_discovered(spark):
    """Short, spaced and dotless forms after known cue words; not numbers after other words, nor short ones after a cue."""
    rows = [(i, f"call me at +49 30 {100000 + i} today") for i in range(24)] + [(99, "call me at 030-123 today"), (98, "call me at 030 12 34 today")]
    rows += [(100 + i, f"mail to user{i}@example.org now") for i in range(8)] + [(199, "mail to user9@localhost now")]
    rows += [(300, "call me at 5 today"), (302, "the total of 123456 parts"), (303, "see 5 10.0.0.1 now"), (304, "mail to box77 now")] + [(400 + i, f"room 77-123{i} today") for i in range(8)]
    found = {r.doc_id: [tuple(x) for x in r["all"]] for r in identifiers.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[99] == [(3, 11, 18)] and found[98] == [(3, 11, 20)] and found[199] == [(0, 8, 23)]
    assert [found[i] for i in (300, 302, 304, *range(400, 408))] == [[]] * 11 and found[303] == [(1, 6, 14)]
    assert all(len(found[i]) == 1 for i in [*range(24), *range(100, 108)])
