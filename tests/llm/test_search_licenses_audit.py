"""Ranked search, licence scan and filter audit against brute force, with odd rows, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from dialogmill.llm import filter_audit, licenses, ranked_search

from test_llm import DOC, ODD

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- 11 ranked search ----


def ranked(items, docs, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        query, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, b, n in bags:
            m = 75 + 25 * n * n_docs // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t, c in query.items() if b[t])
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return out


def order(rows):
    return sorted(rows, key=repr)


def searched(spark, items, docs, k, **options):
    got = ranked_search.search(spark.createDataFrame(items, "item_id long, text string"), docs, k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return order(map(tuple, got.collect()))


def test_search_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = order(ranked(items, [(r.doc_id, r.text) for r in docs.collect()], 20))
    assert searched(spark, items, docs, 20) == want
    assert searched(spark, items, docs, 20, vocabulary=150) == want  # several blocks of items
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert searched(spark, items, docs.repartition(3), 20) == want  # many small batches, each starting from the k-th score before it
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_odd_rows(spark, odd, none):
    items = [(1, "twice TWICE x"), (1, "twice TWICE x"), (None, "me@site.org é"), (4, None), (5, ""), (6, "absent"), (7, "no id here")]
    clash = odd.selectExpr("*", "1 as terms", "2 as n", "3 as tfs", "4 as item", "5 as score", "6 as rank", "7 as w")
    assert searched(spark, items, clash, 3) == order(ranked(items, [r[:2] for r in ODD], 3))
    assert searched(spark, items, none, 3) == [] and searched(spark, [], odd, 3) == []
    same = [(i, "one two", "en", "a", 7) for i in range(50, 0, -1)] + [(99, "three", "en", "a", 5)]
    got = searched(spark, [(1, "two")], spark.createDataFrame(same, DOC), 5)
    assert [x[2] for x in got] == [1, 2, 3, 4, 5] and len({x[3] for x in got}) == 1  # ties by id


def test_best_positions_stop_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, terms, k = int(rng.integers(1, 400)), int(rng.integers(1, 9)), int(rng.integers(1, 8))
        full = np.where(rng.random((terms, n)) < rng.random((terms, 1)), rng.integers(1, 6 if trial % 2 else 10_000, (terms, n)), 0)
        term, place = np.nonzero(full)
        shuffle = rng.permutation(len(term))
        lists = ranked_search.Lists.build(place[shuffle], term[shuffle], full[term, place][shuffle], terms)
        query = [(t, int(rng.integers(0, 5))) for t in range(terms)]
        scores = sum((w * full[t] for t, w in query), np.zeros(n, np.int64))
        kth = int(rng.choice([0, np.sort(scores)[-min(k, n)]]))
        met, got, _ = ranked_search.best_positions(lists, query, k, kth, first=2)
        assert len(set(met)) == len(met) and (scores[met] == got).all()
        least = max(kth, np.sort(scores)[-k] if n >= k else 0, 1)
        assert set(np.flatnonzero(scores >= least)) <= set(met)
    # one document far ahead in every list: a few positions are enough
    full = np.ones((4, 5000), int) * np.arange(5000)
    full[:, 7] = 10**6
    term, place = np.nonzero(full)
    lists = ranked_search.Lists.build(place, term, full[term, place], 4)
    met, _, read = ranked_search.best_positions(lists, [(t, 1) for t in range(4)], 1)
    assert 7 in met and read < 100


# ---- 12 licences ----

NOTICES = [("one", "a b c d e f g h i j k l"), ("two", "c d e x"), ("two", "x y z a b"), ("three", "b c"), ("four", "a a a b")]
PHRASES = [("a b", "ab"), ("b a b", "bab"), ("e x y", "exy")]


def test_automaton_states_are_the_runs_of_the_lists():
    rng = random.Random(2)
    for _ in range(200):
        lists = [[rng.randrange(3) for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 4))]
        automaton = licenses.SuffixAutomaton(lists)
        ends = {}
        for number, words in enumerate(lists):
            for a in range(len(words)):
                for b in range(a + 1, len(words) + 1):
                    ends.setdefault(tuple(words[a:b]), set()).add((number, b))
        text, state, held = [rng.randrange(4) for _ in range(30)], 0, 0
        for i, word in enumerate(text):
            state, held = automaton.step(state, held, word)
            longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in ends))
            assert held == longest
            if held:
                assert set(automaton.ends[state]) == ends[tuple(text[i + 1 - held : i + 1])]


def places(words, phrases):
    return sorted((i, n) for i in range(len(words)) for n, p in enumerate(phrases) if words[i : i + len(p.split())] == p.split())


def test_phrases_and_whole_notices_against_plain_search():
    own, rng = licenses.Scanner(NOTICES, PHRASES), random.Random(4)
    for _ in range(400):
        words = [rng.choice("abcdexyz?") for _ in range(rng.randint(0, 40))]
        names = list(own.vocabulary.order)  # numbers follow the alphabet
        assert sorted(names) == list(range(len(names)))
        spelt = sorted({w for t, *_ in ((n[1],) for n in NOTICES) for w in t.split()} | {w for p, _ in PHRASES for w in p.split()})
        ids = np.array([spelt.index(w) if w in spelt else -1 for w in words], int)
        found, spans = own.scan(ids)
        assert sorted(found) == places(words, [p for p, _ in PHRASES])
        held = {(n, a, b) for n, a, b, _ in spans}
        for number, (_, text) in enumerate(NOTICES):
            size = len(text.split())
            for at, _ in places(words, [text]):  # whole notices are found, or others of the notice that share words with them
                assert any(n == number and a < at + size and b > at for n, a, b in held)


def scan(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan_licenses(docs, **options).collect(), key=lambda r: r.doc_id)]


def test_licences_in_texts(spark):
    apache = next(t for n, t in licenses.NOTICES if t.startswith("you may not use"))
    reworded = apache.replace("express or implied", "stated").replace("in compliance with", "as allowed by")
    rows = scan(spark, [
        "Text before. Released under the MIT License. After", "All rights\nreserved. (c) ALL RIGHTS RESERVED", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "* " + apache.replace(" ", "\n# "), reworded, apache[: len(apache) // 2], "the license of a bird is to be granted free", "mitlicense ccby",
    ])
    assert [r.labels for r in rows] == ["mit", "reserved", "cc-by,cc-by-nc", "cc-by,cc-by-4.0", "gpl,gpl-3.0", "apache-2.0", "apache-2.0", "", "", ""]
    assert [r.base_labels for r in rows] == ["", "reserved", "cc-by", "cc-by", "gpl", "", "", "", "", ""]
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (2, 0, 4) and rows[0].spans[0].asDict() == {"label": "mit", "first_word": 2, "end_word": 7, "covered": 1.0}
    assert [r.score == 1 for r in rows] == [True] * 6 + [False] * 4 and 0.8 <= rows[6].score < 1 and 0.3 < rows[7].score < 0.8 and rows[9].score == 0


def test_licences_base_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        want = places(words, [p for p, _ in licenses.PHRASES])
        g = got[r.doc_id]
        starts = [s for s, _ in want] or [None]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(want), min(starts), max(starts))
        assert g.base_labels == ",".join(sorted({licenses.PHRASES[n][1] for _, n in want})) and set(g.base_labels.split(",")) - {""} <= set(g.labels.split(","))


def test_licences_odd_rows(spark, odd, none):
    rows = licenses.scan_licenses(odd.selectExpr("*", "1 as labels", "2 as score", "3 as spans")).collect()
    assert len(rows) == len(ODD) and Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in rows)
    assert [r.n_words for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert licenses.scan_licenses(none).collect() == []


def test_licences_time_is_linear():
    import time

    own = licenses.Scanner(licenses.NOTICES, licenses.PHRASES)
    words = " ".join(t for _, t in licenses.NOTICES).split()
    ids = own.vocabulary.ids(licenses.Words(*_block(" ".join(words)), licenses.NOT_ALNUM).hashes(True))
    took = []
    for times in (20, 80):
        began = time.process_time()
        own.scan(np.tile(ids, times))
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]  # a square would be 16 times


def _block(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


# ---- 13 filter audit ----


def audited(docs, labels):
    """The rows by walking every order for every document."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    low = {}
    for d, text, *_ in docs:
        if d is not None:
            low[text or ""] = min(low.get(text or "", d), d)
    rows = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > low[text]}
        rows.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for letters in permutations("ABCDE"):
            left = own
            for step, f in enumerate(letters):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out.append([part, "".join(letters), step + 1, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                shapley[part, f] += len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_intervals_are_the_orders():
    for n in (1, 3, 5):
        orders, seen = list(permutations(range(n))), {}
        for mask, step, a, b in filter_audit.removal_intervals(n):
            for rank in range(a, b):
                assert (mask, rank) not in seen
                seen[mask, rank] = step
        for mask in range(1, 1 << n):
            for rank, letters in enumerate(orders):
                assert seen[mask, rank] == next(s + 1 for s, f in enumerate(letters) if mask >> f & 1)


def test_audit(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "SHOUT", "a # b", "SHOUT # " * 40, "x y " * 60, " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(99)), " ".join(f"W{i}" for i in range(130)), "é" * 10 + "A", "aA" + "a" * 8 + "\x0b$"]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "en", "de"]), "s", 1) for _ in range(400)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    frame = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as mask", "2 as part", "3 as n", "4 as rank", "5 as digest", "6 as step")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "'y' as lang", "1 as good")
    got = filter_audit.audit_filters(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)


def test_audit_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit_filters(odd, labels).collect())) == audited(ODD, [])
    assert filter_audit.audit_filters(none, labels).collect() == []
