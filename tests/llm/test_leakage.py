import random
from collections import Counter

import numpy as np

from tasselworks.llm import leakage
from tasselworks.llm.leakage import PHRASE, FMIndex, build_index, leaked_spans, search_index, suffix_array, words_of
from tasselworks.session import Workspace


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - PHRASE + 1):
            grams.setdefault(tuple(w[k : k + PHRASE]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t)
        for k in range(len(w) - PHRASE + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + PHRASE]), ())}
    return out


def test_index_against_brute_force():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 5, 3000)
    seq[-1] = 0
    order = suffix_array(seq)
    symbols = [(int(c), k) if c == 0 else (int(c), -1) for k, c in enumerate(seq)]
    assert order.tolist() == sorted(range(3000), key=lambda k: symbols[k : k + 60])
    index = FMIndex.build(seq, 4)
    for n in (1, 2, 4):
        phrases = rng.integers(1, 5, (40, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [k for k in range(3000 - n + 1) if (seq[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 300)
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(12)] + [(90, None), (91, "too short"), (92, "")]
    docs = [(1, None), (2, ""), (3, "w1 w2")]
    for d in range(10, 160):
        text = [rng.choice(vocabulary + ["other"]) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            w = items[d % 12][1].split()
            a, n = rng.randrange(20), rng.randrange(10, 16)
            text[5:5] = w[a : a + n]
        docs.append((d, ", ".join(text).upper() if d % 2 else " ".join(text)))
    docs.append((500, "x " + items[0][1].replace("w", "Ẃ") + " y"))  # accents and case
    docs.append((501, " ".join([items[1][1]] * 50)))  # longer than a shard
    docs.append((502, items[2][1])), docs.append((502, items[2][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    idf = spark.createDataFrame(items, "item_id long, text string")
    ws = Workspace(spark, "t")
    index = build_index(df, ws)
    out = search_index(index, idf, ws)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == brute(docs, items)
    # several blocks of items, against the index that is there
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 90)
    assert Counter(map(tuple, search_index(index, idf, ws).collect())) == Counter(map(tuple, out.collect()))
    spans = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in out.collect() if r.doc_id == 500}
    assert spans[500, 0] == (1, 41)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert leaked_spans(docs, items.limit(0), Workspace(spark, "t")).count() == 0
    assert leaked_spans(docs.limit(0), items, Workspace(spark, "t")).count() == 0


def test_boilerplate_of_many_items_is_one_span_each(spark):
    shared = " ".join(f"s{k}" for k in range(30))
    items = [(k, f"own{k} {shared} tail{k} " + " ".join(f"x{k}y{n}" for n in range(12))) for k in range(50)]
    docs = [(1, " . ".join([shared] * 40)), (2, items[3][1]), (None, shared), (1, "a " + shared)]
    out = leaked_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Workspace(spark, "t")).collect()
    got = Counter((r.doc_id, r.item_id, r.first_word, r.end_word) for r in out)
    # forty copies in a row touch and are one span; the repeated id is a text of its own
    assert got[1, 7, 0, 1200] == 1 and got[1, 7, 1, 31] == 1 and got[None, 7, 0, 30] == 1
    assert got[2, 3, 0, 44] == 1 and got[2, 4, 1, 31] == 1 and len(out) == 50 * 4
