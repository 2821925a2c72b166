"""Toxicity against a plain recount: lexicon, features, trees and isotonic step of every text."""

import inspect
import math
import zlib
from collections import defaultdict

import pytest

from conftest import SF_SMALL
from regspark.llm import toxicity as X


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def plain_word(word):
    low = word.lower()
    letters = [i for i, c in enumerate(low) if c.isalpha()]
    return low[letters[0]:letters[-1] + 1] if letters else ""


def plain_units(word):
    w = plain_word(word)
    return ({"=" + w} if len(w) >= 3 else set()) | {w[:n] for n in (4, 5, 6) if len(w) > n}


def plain_features(text, lexicon):
    """The rates word by word, character by character."""
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    if not n:
        return [0.0] * len(X.FEATURES)
    whole = begin = caps = mixed = stretched = 0
    weights, kinds, hits, you = 0.0, set(), [], []
    for i, word in enumerate(words):
        found = sorted(((lexicon[u], u) for u in plain_units(word) if u in lexicon), key=lambda x: -x[0])
        whole += any(u.startswith("=") for _, u in found)
        begin += any(not u.startswith("=") for _, u in found)
        if found:
            hits.append(i)
            weights += found[0][0]
            best = [u for z, u in found if z == found[0][0]]
            order = [u for u in X.units_of(word) if u in best]          # of equal weights the first unit counts
            kinds.add(order[0])
        low = plain_word(word)
        if low in X.SECOND_PERSON:
            you.append(i)
        caps += len(low) > 1 and word.isupper()
        letter = lambda c: c.isalpha()
        mixed += bool(re.search(r"[^\W\d_][\d@$!*#_.\-]+[^\W\d_]", word))
        stretched += any(low[k] == low[k + 1] == low[k + 2] and letter(low[k]) for k in range(len(low) - 2))
    near = sum(any(abs(i - j) <= X.NEAR for j in hits) for i in you)
    size = len(text.encode())
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    return [whole / n, begin / n, weights / n, float(len(kinds)), float(len(hits)), near / n, len(you) / n,
            upper / max(1, upper + lower), caps / n, text.count("!") / n, text.count("?") / n,
            sum(text.count(c) for c in ".,;:'\"-()") / size, sum(text.count(c) for c in "#*$%&|<>@_~^") / size,
            mixed / n, stretched / n, math.log(1 + n)]


def walk(node, row):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if row[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    score = X.train(docs, labels)
    inner = inspect.getclosurevars(score).nonlocals
    return docs, labels, score, inner["lexicon"], inspect.getclosurevars(inner["raw"]).nonlocals["trees"], inner["steps"]


def test_lexicon_is_the_recount(trained):
    docs, labels, _, lexicon, _, _ = trained
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and fold(r.doc_id) != X.HELD_OUT}
    by_text = defaultdict(int)
    for r in docs.collect():
        if r.doc_id in marks:
            by_text[r.text] = max(by_text[r.text], marks[r.doc_id])
    share = sum(by_text.values()) / len(by_text)
    n, t = defaultdict(int), defaultdict(int)
    for text, toxic in by_text.items():
        for u in set().union(*map(plain_units, (text or "").split())):
            n[u] += 1
            t[u] += toxic
    z = {u: (t[u] - n[u] * share) / math.sqrt(n[u] * share * (1 - share)) for u in n if n[u] >= X.MIN_DOCS}
    want = {u: v for u, v in z.items() if v >= X.MIN_Z}
    assert len(want) <= X.LEXICON and lexicon.keys() == want.keys()
    assert all(lexicon[u] == pytest.approx(want[u]) for u in want)


def test_features_are_the_recount(trained):
    _, _, _, lexicon, _, _ = trained
    lexicon = lexicon or {"=idiot": 9.0}
    texts = [r.text or "" for r in trained[0].collect()] + [
        "", "   ", "YOU i.d.i.o.t!!! sooooo b@d", "tú — ¿qué?", "x " * 50 + "you " + " ".join(u.lstrip("=") for u in list(lexicon)[:9])]
    facts = X.WordFacts(lexicon)
    for text in texts:
        assert X.features_of(text.encode(), facts) == pytest.approx(plain_features(text, lexicon)), text[:80]


def test_scores_are_the_recount(trained):
    docs, _, score, lexicon, trees, steps = trained
    roots = [(w, t._call_java("rootNode")) for t, w in zip(trees.trees, trees.treeWeights)]
    xs, ys = list(steps.boundaries), list(steps.predictions)

    def step(p):
        if p <= xs[0]:
            return ys[0]
        for (a, fa), (b, fb) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
            if p <= b:
                return fb if a == b or p == b else fa + (fb - fa) * (p - a) / (b - a)
        return ys[-1]
    got = {r.doc_id: (r.text, r.score) for r in score(docs).collect()}
    assert len(got) == docs.count()
    for doc_id, (text, value) in sorted(got.items())[::4]:
        row = X.features_of((text or "").encode(), X.WordFacts(lexicon))
        p = 1 / (1 + math.exp(-2 * sum(w * walk(root, row) for w, root in roots)))
        assert value == pytest.approx(0.999 * step(p) + 0.001 * p, abs=1e-9), doc_id
