"""Periodic runs: against all periods of every text, and the defined cases."""

import hashlib
import random
import zlib

import numpy as np

from conftest import SF_SMALL

RUN = ("start", "length", "period")


def all_runs(words):
    """Every period tried on the whole text."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    found = {}
    for q in range(1, len(x) // 3 + 1):
        edge = np.diff(np.r_[0, (x[:-q] == x[q:]).astype(int), 0])
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q):
            if e - s >= max(24, 3 * q):
                found.setdefault((int(s), int(e)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_grammar_derives_its_text():
    from regspark.llm.periodic_runs import Grammar, repeated_pairs
    for text in ("abababab", "aaaaaaaaaaaaa", "abcabcabxabcab", "mississippimississippi"):
        ids = [ord(c) - 97 for c in text]
        x = np.array(ids)
        g = Grammar(list(ids), repeated_pairs(x, np.zeros(len(x), np.int64), 30).get(0, {}), 30)

        def derived(s):
            return [s] if s < 30 else derived(g.rules[s - 30][0]) + derived(g.rules[s - 30][1])
        top = [s for s in g.sym if s >= 0]
        assert [w for s in top for w in derived(s)] == ids
        for k, places in enumerate(g.places()):
            assert all(ids[i:i + g.length[k]] == derived(30 + k) for i in places) and min(places) == g.first[k]
        # a greedy left to right reading finds no pair of symbols twice
        pairs, last = {}, None
        for i in range(len(top) - 1):
            pair = (top[i], top[i + 1])
            if not (pair[0] == pair[1] and last == i - 1):
                pairs[pair] = pairs.get(pair, 0) + 1
                last = i
        assert max(pairs.values(), default=1) == 1


def test_runs_of_random_texts():
    from regspark.llm.periodic_runs import runs_of
    draw = random.Random(7)
    texts = []
    for _ in range(300):
        t = []
        for _ in range(draw.randint(1, 8)):
            w = [draw.randrange(draw.choice([1, 2, 3, 5, 50])) for _ in range(draw.randint(1, 40))]
            if draw.random() < 0.3:
                w = w * draw.randint(1, 4) + w[:draw.randint(0, len(w))]
            t += w * draw.randint(1, 6) + w[:draw.randint(0, len(w))]
        texts.append([str(v).encode() for v in t])
    want = [all_runs(t) for t in texts]
    assert runs_of(texts) == want and sum(map(len, want)) > 500
    assert [runs_of([t])[0] for t in texts[:40]] == want[:40]


def test_query_against_all_periods(spark):
    from regspark.llm.queries import QUERIES
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()}
    assert len(got) == len(source)
    for doc_id, text in source:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = all_runs(words)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        if runs:
            from fractions import Fraction
            s, m, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert sum(r.n_runs for r in got.values()) > 5


def test_defined_cases(spark):
    from regspark.llm.periodic_runs import periodic_runs
    long = " ".join(f"w{i}" for i in range(50_000)) + " x y z" * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, "é ß " * 12),
            (6, long), (7, "a b c d e f g h i " * 2 + "a b c d e f"), (8, "p q " * 12 + "x " * 48)]
    docs = (spark.createDataFrame(rows, "doc_id long, text string")
            .selectExpr("*", "'clash' start", "'clash' runs", "'clash' period", "cast(null as string) lang"))
    got = periodic_runs(docs, group_words=60).collect()
    assert len(got) == len(rows) and periodic_runs(docs.limit(0)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].n_runs for i in (1, 2, 3, 4, 7)] == [0] * 5 and by[1][0].top is None and by[1][0].collapsed == ""
    assert len(by[5]) == 2 and all(tuple(r.top) == (0, 24, 1) and r.collapsed == "a" for r in by[5])
    assert tuple(by[None][0].top) == (0, 24, 2) and by[None][0].collapsed == "é ß"
    assert tuple(by[6][0].top) == (50_000, 60_000, 3)
    assert [tuple(r) for r in by[8][0].runs] == [(0, 24, 2), (24, 48, 1)] and tuple(by[8][0].top) == (24, 48, 1)
    assert all(r.start == "clash" and r.lang is None for r in got)
    assert not periodic_runs(docs.select("text")).columns[0].startswith("__")
