"""Ranked search: bounds over exact scores, brute force with ties and copies, defined cases."""

import collections
import math
import random
import re


def exact(docs, items, k=10):
    """{(item row): [(doc_id, score)]} by the formula, over all documents."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    texts = [(i, cut.findall((t or "").translate(lower))) for i, t in docs]
    texts = [(i, collections.Counter(ts), len(ts)) for i, ts in texts if ts]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = collections.Counter(t for _, c, _ in texts for t in c)
    out = {}
    for item, text in set(items):
        asked = collections.Counter(cut.findall((text or "").translate(lower)))
        found = []
        for doc_id, c, n in texts:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out[item, text] = [(None if none else d, -s) for s, none, d in sorted(found)[:k]]
    return out


def ranking(rows):
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.item_id].append((r.doc_id, r.score))
    return dict(got)


def made(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 1) for i in range(400)]
    return [" ".join(draw.choices(words, odds, k=draw.choice([3, 20, 60, 300]))) for _ in range(n)]


def test_bounds_reach_every_score():
    from regspark.llm.ranked_search import Block, Corpus, _bound_task, _score_task, sketch, terms
    import pyarrow as pa
    texts = made(1, 120)
    block = Block(list(enumerate(made(2, 15))))
    found = [terms(t.encode()) for t in texts]
    df = [sum(t in set(f) for f in found) for t in block.terms]
    corpus = Corpus(len(texts), sum(map(len, found)), df)
    rows = [sketch(f) for f in found]
    keys = [str(i).encode() for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({
        "text_key": keys, "n": [len(f) for f in found], "width": [w for w, _, _ in rows],
        "coords": [a.tobytes() for _, a, _ in rows], "peaks": [p.tobytes() for _, _, p in rows]})
    bound = {(r["item"], r["text_key"]): r["bound"] for b in _bound_task(block, corpus, 10, [1] * 15)(iter([batch])) for r in b.to_pylist()}
    full = pa.RecordBatch.from_pydict({"text_key": keys, "text": texts, "items": [list(range(15))] * len(texts)})
    scores = [r for b in _score_task(block, corpus)(iter([full])) for r in b.to_pylist()]
    assert len(scores) > 1000 and all(bound[r["item"], r["text_key"]] >= r["score"] for r in scores)
    tight = sum(bound[r["item"], r["text_key"]] < 1.5 * r["score"] + 1000 for r in scores)
    assert tight > 0.5 * len(scores)
    # the head of a task are its greatest bounds
    head = [r for b in _bound_task(block, corpus, 3, None)(iter([batch])) for r in b.to_pylist()]
    for q in range(15):
        want = sorted((v for (i, _), v in bound.items() if i == q), reverse=True)[:3]
        assert sorted((r["bound"] for r in head if r["item"] == q), reverse=True) == want


def test_against_all_documents(spark):
    from regspark.llm.ranked_search import ranked_search
    texts = made(3, 300)
    copy = texts[7]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(5000 - i, copy) for i in range(200)]
    items = list(enumerate(made(4, 20))) + [(20, copy)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = {i: v for (i, _), v in exact(docs, items).items()}
    assert ranking(ranked_search(table, asked).collect()) == want
    assert ranking(ranked_search(table, asked, head=2, block_bytes=500).collect()) == want
    assert ranking(ranked_search(table, asked, k=3).collect()) == {i: v[:3] for i, v in want.items()}


def test_defined_cases(spark):
    from regspark.llm.ranked_search import ranked_search
    long = " ".join(f"t{i % 9000}" for i in range(60_000)) + " Needle"
    docs = [(1, None), (2, ""), (3, " -_- "), (4, "Red RED apple"), (4, "Red RED apple"), (4, "green apple"), (None, "red apple"),
            (5, "Äpfel äpfel"), (6, long), (7, "needle " * 300)]
    items = [(1, "red apple apple"), (1, "red apple apple"), (2, None), (3, "..."), (4, "needle"), (5, "Äpfel"), (6, "unknown"), (None, "green")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' score", "1 n", "2 text_key", "3 rank")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' id", "1 doc_id")
    got = ranking(ranked_search(table, asked).collect())
    want = {i: v for (i, t), v in exact(docs, items).items() if v}
    assert got == want and set(got) == {1, 4, 5, None} and [d for d, _ in got[1]][:2] == [4, 4]
    assert ranked_search(table.limit(0), asked).count() == 0 and ranked_search(table, asked.limit(0)).count() == 0
    assert ranked_search(table.where("doc_id <= 3"), asked).count() == 0
