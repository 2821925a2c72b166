"""Training-data operators against brute force on the smallest test tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from conftest import SF_SMALL
from regspark.llm.queries import QUERIES

WORD_TABLE = "documents"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: (r[1] or "").encode() for r in rows}


def result(spark, name):
    return QUERIES[name](spark, SF_SMALL).collect()


def shingles(words, k):
    if not words:
        return []
    k = min(k, len(words))
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def test_decontamination_finds_every_window_over_the_threshold(spark, docs):
    items = {r[0]: (r[1] or "").encode().lower().split() for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()}
    want = {}
    for d, text in docs.items():
        words = text.lower().split()
        own = set(shingles(words, 5))
        for i, item in items.items():
            a = shingles(item, 5)
            if not own & set(a):
                continue
            best, counts = 0.0, collections.Counter(a)
            all_of = shingles(words, 5)
            size = min(len(a), len(all_of))
            for s in range(len(all_of) - size + 1):
                both = sum((counts & collections.Counter(all_of[s:s + size])).values())
                best = max(best, both / (len(a) + size - both))
            if best >= 0.8:
                want[d, i] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in result(spark, "op1_decontamination")}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_block_lookup_misses_no_fingerprint_within_the_radius():
    from regspark.llm.decontaminate import BITS, RADIUS, block_tables, candidates
    rng = np.random.default_rng(3)
    items = rng.integers(0, 256, (40, BITS // 8), dtype=np.uint8)
    bits = np.unpackbits(items, axis=1)
    near = []
    for i in range(len(items)):
        for flips in (0, 10, RADIUS, RADIUS + 1, 100):
            x = bits[i].copy()
            x[rng.choice(BITS, flips, replace=False)] ^= 1
            near.append(np.packbits(x))
    near = np.array(near)
    w, i, d = candidates(near, block_tables(items), items)
    exact = np.unpackbits(near[:, None, :] ^ items[None], axis=2).sum(axis=2)
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact <= RADIUS))))


def test_fingerprints_sign_every_occurrence_of_a_shingle():
    from regspark.llm.decontaminate import bit_signs, fingerprints, ranked
    rng = np.random.default_rng(8)
    for size, n, kinds in ((1, 9, 3), (7, 40, 4), (25, 25, 6), (30, 200, 12), (30, 200, 1 << 60)):
        h = rng.integers(1, 1 << 62, 300).astype(np.uint64)[rng.integers(0, min(kinds, 300), n)]
        starts = np.arange(3 if n > size + 3 else 0, n - size + 1)
        for s, got in zip(starts, fingerprints(h, starts, size)):
            seen, ranks = collections.Counter(), []
            for x in h[s:s + size].tolist():
                ranks.append(seen[x])
                seen[x] += 1
            want = bit_signs(ranked(h[s:s + size], np.array(ranks))).astype(int).sum(0) > 0
            assert (np.packbits(want) == got).all()


def test_decontamination_finds_items_with_a_run_of_one_word(spark):
    from regspark.llm.decontaminate import contaminated
    rng = np.random.default_rng(9)
    items, docs = [], []
    for i in range(20):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(183)]
        other = [f"x{rng.integers(1 << 40)}" for _ in range(17)]
        items.append((i, " ".join(words[:90] + ["same"] * 17 + words[90:])))
        docs.append((100 + i, " ".join(["before"] * 9 + words[:90] + other + words[90:] + ["after"] * 9)))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i in range(20)}
    assert all(0.8 <= r.similarity < 0.82 for r in got)


def test_substring_dedup_removes_exactly_the_repeated_windows(spark, docs):
    seen, want = set(), {}
    for d in sorted(docs):
        words = docs[d].split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            gram = tuple(words[s:s + 20])
            if gram in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(gram)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[d] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, "op2_substring_dedup")} == want


def test_lm_scoring_counts_and_base_score(spark, docs):
    count = collections.Counter()
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    tokens = {d: t.lower().split() + [b""] for d, t in docs.items()}
    for d in docs:
        if not held[d]:
            count.update(tokens[d])
    n, v = sum(count.values()), len(count)
    rows = result(spark, "op3_lm_scoring")
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(x in count for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_lm_head_and_tail_give_the_same_scores(spark):
    from regspark.llm.language_model import score_texts
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    a = {r.doc_id: (r.score, r.base_score, r.n_known) for r in score_texts(table).collect()}
    b = {r.doc_id: (r.score, r.base_score, r.n_known) for r in score_texts(table, head_words=20).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-5)


def test_lm_probabilities_of_a_context_sum_to_one(spark):
    from regspark.llm.language_model import C, T, train
    table = spark.createDataFrame([("the cat of the hat and the rat",), ("of cat and of dog",), ("the end",)], "text string")
    for state, model in train(table):
        rows = state.collect()
        c = np.array([[r[x] for x in C] for r in rows])
        t = np.array([[r[x] for x in T] for r in rows])
        assert ((t >= (c > 0)) & (t <= c)).all()
        p = model.contextual(c, t, model.unigram(t.sum(1)))
        assert p.sum(0) + model.unseen() == pytest.approx(np.ones(len(C)))


def test_packing_is_gapless_and_tight(spark, docs):
    from tokenizers import Tokenizer
    from regspark.llm.packing import vocabulary_path
    coder = Tokenizer.from_file(vocabulary_path())
    want = []
    for d, text in docs.items():
        ids = coder.encode(text.decode(), add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a:a + 2048], "<u4")
            want.append((d, k, a, len(part), zlib.crc32(part.tobytes())))
    rows = result(spark, "op4_best_fit_packing")
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.01 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_packed_sequences_round_trip(spark):
    from regspark.llm.packing import pack, sequences
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(40)
    packed = pack(table, with_ids=True)
    rows = packed.collect()
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in rows:
        own = whole[r.sequence_id][r.offset:r.offset + r.length]
        assert list(own) == list(r.ids) and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    from regspark.llm.packing import plan
    rng = np.random.default_rng(seed)
    counts = collections.Counter(rng.integers(1, 65, 300).tolist())
    used, n = collections.Counter(), 0
    for pattern, times in plan(counts, 64):
        assert sum(pattern) <= 64 and times > 0
        n += times
        for x in pattern:
            used[x] += times
    assert used == counts
    assert n <= math.ceil(sum(k * v for k, v in counts.items()) / 64) + 8


def test_sharding_is_even_and_gapless(spark, docs):
    rows = result(spark, "op5_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 8, zlib.crc32(t)) for d, t in docs.items()}
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2.2 * max(r.size for r in rows)


def test_sharding_splits_a_text_that_a_third_of_the_rows_share(spark):
    from regspark.llm.sharding import assign_shards
    rows = [(i, "same text " * 9 if i % 3 == 0 else f"text {i} " * 9) for i in range(1500)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 1500 and max(size.values()) < 1.1 * min(size.values())


def linked(docs, k):
    sets = {d: set(shingles(t.lower().split(), k)) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where = collections.defaultdict(list)
    for d in sorted(docs):
        near = {e for s in sets[d] for e in where[s]}
        for e in near:
            both = len(sets[d] & sets[e])
            if 100 * both >= 80 * (len(sets[d]) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            where[s].append(d)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


def test_near_dedup_components(spark, docs):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result(spark, "op6_near_dedup")} == linked(docs, 2)


def test_near_dedup_of_a_group_larger_than_a_cell(spark):
    """Copies of one text with up to a sixth of the words changed: not all are linked directly."""
    from regspark.llm.near_dedup import near_duplicates
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(300):
        words = list(base)
        for i in rng.choice(60, rng.integers(0, 5), replace=False):
            words[i] = f"x{rng.integers(1000)}"
        texts[d] = " ".join(words).encode()
    table = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table, 2).collect()}
    assert got == linked(texts, 2)


def test_sketches_merge_and_estimate():
    from regspark.llm.near_dedup import likelihood_estimate, registers
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = h[:1000], h[200:1200]
    sets = [a, b, np.union1d(a, b)]
    n = np.array([len(s) for s in sets])
    k = registers(np.concatenate(sets), np.repeat(np.arange(3), n), n)
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    x, y = k[0].astype(int), k[1].astype(int)
    one = lambda v: np.array([float(v)])
    got = likelihood_estimate(one((x > y).sum()), one((x < y).sum()), one((x == y).sum()), one(1000), one(1000))[0]
    assert abs(got - 800 / 1200) < 0.12


def test_components_of_chains_and_stars(spark):
    from regspark.llm.components import components
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 50), (61, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 30)}, 60: 60, 61: 60}


def test_quality_base_features(spark, docs):
    for r in result(spark, "op9_quality_rules"):
        text = docs[r.doc_id]
        words = text.split()
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        n = collections.Counter(grams)
        hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split(b"\n") if x.split()]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), len(b"".join(words).decode()), sum(c in b"#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)
        assert not (r.kept and failed)


def test_quality_bands():
    import base64
    import random
    from regspark.llm.quality_rules import BANDS, CHUNK_BAND, CHUNK_BYTES, LEVEL, MAX_ODD_CHUNKS, judge
    import zstandard
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    verdict = lambda x: judge(x, lambda y: len(press(y)) / len(y), BANDS, CHUNK_BYTES, CHUNK_BAND, MAX_ODD_CHUNKS)[2]
    rng = random.Random(2)
    parts = "an er in on re th at st nd or es en of te ed is it al ar to".split()
    prose = lambda n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)).encode()
    noise = base64.b64encode(rng.randbytes(30_000))
    assert verdict(b"buy now " * 200) == "repetitive"
    assert verdict(noise) == "incompressible"
    assert verdict(prose(700)) is None
    assert verdict(prose(4000) + noise[:16384]) is not None
    assert verdict(b"ab") is None and verdict(b"") is None


def test_quality_judges_the_tail_of_a_text():
    import base64
    import random
    from regspark.llm.quality_rules import BANDS, CHUNK_BAND, CHUNK_BYTES, LEVEL, MAX_ODD_CHUNKS, chunks_of, judge
    import zstandard
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    verdict = lambda x: judge(x, lambda y: len(press(y)) / len(y), BANDS, CHUNK_BYTES, CHUNK_BAND, MAX_ODD_CHUNKS)[2]
    rng = random.Random(4)
    parts = "an er in on re th at st nd or es en of te ed is it al ar to".split()
    prose = " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(9000)).encode()
    noise = base64.b64encode(rng.randbytes(3000))
    for clean in (1, 2):
        start = prose[:clean * CHUNK_BYTES]
        assert verdict(start + noise[:4000]) == "incompressible chunks"
        assert verdict(start + (b"buy now " * 500)[:4000]) in ("repetitive", "repetitive chunks")
    assert verdict(prose[:CHUNK_BYTES] + noise[:2100]) == "incompressible chunks"
    for n in (1, 255, 256, 4095, 4096, 4097, 4351, 4352, 8191, 8192, 12_000, 20_479):
        got = chunks_of(prose[:n], BANDS, CHUNK_BYTES, CHUNK_BAND)
        assert b"".join(c for c, _ in got) == (prose[:n] if n >= CHUNK_BYTES else b"")
        assert "chunks" not in (verdict(prose[:n]) or "")     # a clean tail is not odd


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].score, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_urls_by_rule(spark):
    from regspark.llm.url_filters import judge_urls
    urls = {1: "http://a.example.com/en/1", 2: "https://www.example.com/en/x?y", 3: "HTTP://A.COM/", 4: "http://b.net/fr/a", 5: None,
            6: "no scheme", 7: "http://host.org", 8: "http://notexample.com/en/1", 9: "http://x.net/en/1", 10: "http://A.Net/es/#t"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           judge_urls(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert got == {1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
                   3: ("a.com", "/", "com/", "allow"), 4: ("b.net", "/fr/a", "net/fr/", "block"), 5: ("", "", None, "allow"),
                   6: ("", "", None, "allow"), 7: ("host.org", "", None, "allow"), 8: ("notexample.com", "/en/1", "com/", "allow"),
                   9: ("x.net", "/en/1", None, "allow"), 10: ("a.net", "/es/", "net/es/", "block")}


def test_url_templates_and_purity(spark):
    from regspark.llm.url_filters import judge_urls, templates
    paths = [("h", f"/blog/{w}/{i}.html", 1) for i, w in enumerate("abcdefghijklmnopqrst")] + [("h", "/about", 3)]
    got = {r.path: r.template for r in templates(spark.createDataFrame(paths, "host string, path string, n long")).collect()}
    assert set(got.values()) == {"/blog/*/*.html", "/about"}
    # one branch mostly blocked by rule: its unlabelled pages go too; another branch stays
    urls = [f"http://h.net/shop/{i}" for i in range(60)] + ["http://h.net/shop/99x"] + [f"http://h.net/news/{i}" for i in range(40)]
    rules = [("h.net", f"/shop/{i}", "block") for i in range(1, 6)]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = {r.path: r.verdict for r in rows}
    assert by["/shop/0"] == "block" and by["/shop/6"] == "block" and by["/shop/99x"] == "allow"
    assert all(v == "allow" for p, v in by.items() if p.startswith("/news/"))


def test_urls_without_labels_follow_alike_branches_only(spark):
    from regspark.llm.url_filters import judge_urls

    def verdicts(rules):
        urls = [f"http://h.net/{part}/page-{i}" for part in ("es", "fr", "en", "de") for i in "abcdefghijklmnopqrst" for _ in (1, 2)]
        rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
        return {r.path.split("/")[1]: r.verdict for r in rows}
    # two labelled branches are alike: those without labels go with them
    assert verdicts([("net", "/es/", "block"), ("net", "/fr/", "block")]) == dict.fromkeys(("es", "fr", "en", "de"), "block")
    # they differ, or there is one only, or none is labelled on this host: nothing is inherited
    assert verdicts([("net", "/es/", "block"), ("net", "/fr/", "allow")]) == {"es": "block", "fr": "allow", "en": "allow", "de": "allow"}
    assert verdicts([("net", "/es/", "block")]) == {"es": "block", "fr": "allow", "en": "allow", "de": "allow"}
    assert set(verdicts([("org", "/", "block")]).values()) == {"allow"}


def test_chat_prompt_is_the_longest_common_prefix(spark):
    from regspark.llm.chat_format import preference_format
    schema = "pair_id long, turn long, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
              (2, 0, "user", "q"), (2, 1, "assistant", "same"), (3, 0, "user", "only <|here|>")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "assistant", "x"),
                (2, 0, "user", "q"), (2, 1, "assistant", "same")]
    got = {r.pair_id: r for r in preference_format(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    one = got[1]
    assert one.n_prompt_turns == 3
    assert one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nA<|end|>\n<|user|>\nmore<|end|>\n"
    assert one.chosen == "<|assistant|>\ngood<|end|>\n"
    spans = [one.rejected[a:b] for a, b in zip(one.rejected_mask[::2], one.rejected_mask[1::2])]
    assert spans == ["bad<|end|>\n", "x<|end|>\n"]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (2, "", "", [])
    assert (got[3].n_prompt_turns, got[3].prompt, got[3].rejected) == (0, "", "")
    assert got[3].chosen == "<|user|>\nonly < |here|><|end|>\n"


def test_word_tokens_equal_the_tokenizer():
    import random
    from regspark.llm.packing import WordTokens, vocabulary_path
    tokens = WordTokens(vocabulary_path())
    rng = random.Random(1)
    signs = "abcXYZ'stremvdl.,!?-_#0123456789éÉßÑñüÜÿÀ×÷µªº“—İıΣσς<|>endoftext́ ᱰ\x1c\x7f\x00🙂ﬁ①²"
    words = ["".join(rng.choices(signs, k=rng.randint(1, 9))).encode() for _ in range(20_000)]
    words += [w.encode() for w in ("<|endoftext|>", "a<|startoftext|>b", "don't", "we'll", "\"'s", "'S", "I'M", "ÀÉ'RE", "Straße")]
    words = [w for w in words if len(w.split()) == 1]
    want = tokens.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
    assert all(tokens.word(w) == np.array(c.ids, "<u4").tobytes() for w, c in zip(words, want))


def plainly_kept(text):
    """Stage 1 in plain Python: base rule, whole-text limits, limits of the chunks."""
    import zstandard
    from regspark.llm.quality_rules import BANDS, CHUNK_BAND, CHUNK_BYTES, LEVEL, MAX_ODD_CHUNKS, MIN_WORDS
    ratio = lambda x: len(zstandard.ZstdCompressor(level=LEVEL).compress(x)) / len(x)
    limits = lambda n: [b[1:] for b in BANDS if b[0] <= n][-1]
    words = text.split()
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    if len(words) < MIN_WORDS or 100 * len(hit) > 50 * len(words):
        return False
    if len(text) >= BANDS[0][0] and not limits(len(text))[0] <= ratio(text) <= limits(len(text))[1]:
        return False
    odd, at = 0, 0
    while len(text) >= CHUNK_BYTES and at < len(text):
        left = len(text) - at
        size = left if left < CHUNK_BYTES + BANDS[0][0] and left != CHUNK_BYTES else CHUNK_BYTES
        low, high = CHUNK_BAND
        if left < CHUNK_BYTES:
            low, high = low + limits(left)[0] - limits(CHUNK_BYTES)[0], max(high, limits(left)[1])
        odd += 0 if low <= ratio(text[at:at + size]) <= high else size
        at += size
    return odd <= MAX_ODD_CHUNKS * len(text)


def test_pipeline_against_plain_python(spark, monkeypatch):
    import corpus_pipeline as P
    from regspark.llm.tables import written
    stages = []
    monkeypatch.setattr(P, "written", lambda df, name: stages.append(written(df, name)) or stages[-1])
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    last = {r.doc_id for r in P.run(spark, SF_SMALL).select("doc_id").distinct().collect()}
    got = [{r.doc_id: (r.text or "").encode() for r in x.select("doc_id", "text").collect()} for x in stages]

    first = {r.doc_id: t for r in source if plainly_kept(t := (r.text or "").encode())}
    assert got[0] == first and len(first) < len(source)

    links = linked(first, 5)
    second = {d: t for d, t in first.items() if links[d][2]}
    assert got[1] == second and len(second) < len(first)

    seen, third = set(), {}
    for d in sorted(second):
        words = second[d].split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if (gram := tuple(words[s:s + 20])) in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(gram)
        third[d] = [w for w, x in zip(words, gone) if not x]
    assert {d: t.split() for d, t in got[2].items()} == third
    assert sum(map(len, third.values())) < sum(len(t.split()) for t in second.values())

    items = [shingles((r[0] or "").encode().lower().split(), 5) for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("text").collect()]
    leaked = set()
    for d, t in got[2].items():
        all_of = shingles(t.lower().split(), 5)
        for a in items:
            if not a or not set(all_of) & set(a):
                continue
            size, counts = min(len(a), len(all_of)), collections.Counter(a)
            for s in range(len(all_of) - size + 1):
                both = sum((counts & collections.Counter(all_of[s:s + size])).values())
                if both / (len(a) + size - both) >= 0.8:
                    leaked.add(d)
    assert got[3] == {d: t for d, t in got[2].items() if d not in leaked} and leaked
    assert last == set(got[3])


def test_buckets_are_cut_only_where_no_link_can_cross(spark):
    from pyspark.sql import functions as F
    from regspark.llm.near_dedup import BANDS, REGISTERS, ROWS, equal_share, first_gap, ties_of
    rows = [([98, 97, 60, 55, 4, 2],), ([30, 2],), ([100],), ([80, 31],)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<int>").select(first_gap(F.col("s"), 49)).collect()]
    assert got == [55, 100, 100, 31]
    import pyarrow as pa
    x = np.arange(2 * REGISTERS, dtype=np.uint16).reshape(2, -1)
    y = x.copy()
    y[0, :75] += 1
    assert equal_share(*(pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, y))).to_pylist() == [75, 100]
    # four sketches share one band: 2 and 3 are near each other, none is near 1, and 4 is alone
    rng = np.random.default_rng(5)
    sketches = rng.integers(0, 60000, (4, REGISTERS)).astype(np.uint16)
    sketches[2] = sketches[1]
    sketches[2, :60] = 1
    sketches[:, ROWS * (BANDS - 1):] = 7
    table = spark.createDataFrame([(i + 1, bytearray(s.tobytes())) for i, s in enumerate(sketches)], "f1 long, sketch binary")
    assert {tuple(r) for r in ties_of(table, 0.8).collect()} == {(3, 2)}
    assert {tuple(r) for r in ties_of(table, 0.8, rounds=0).collect()} >= {(2, 1), (3, 1), (4, 1)}
    assert ties_of(table.limit(0), 0.8).count() == 0


def test_a_group_of_near_copies_has_about_one_tie_a_class(spark):
    """Classes meet the group's few least ones in many bands: as ties these are not listed for each class."""
    from regspark.llm.components import components
    from regspark.llm.near_dedup import REGISTERS, ties_of
    rng = np.random.default_rng(7)
    base = rng.integers(0, 60000, (3, REGISTERS))
    sketches = np.repeat(base, 200, axis=0)
    changed = rng.random(sketches.shape) < 0.1
    sketches[changed] = rng.integers(0, 60000, changed.sum())
    rows = [(i + 1, bytearray(s.tobytes())) for i, s in enumerate(sketches.astype(np.uint16))]
    ties = ties_of(spark.createDataFrame(rows, "f1 long, sketch binary"), 0.8).collect()
    assert len(ties) < 2 * len(rows) and all(r.b < r.a for r in ties)
    got = components(spark.createDataFrame(ties, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i + 1: 1 + i // 200 * 200 for i in range(600)}


def test_near_dedup_deals_sketches_and_texts_of_clusters_only(spark, monkeypatch):
    from regspark.llm import near_dedup
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(40))) for i in range(300)]
    rows += [(1000, rows[7][1] + " more"), (1001, "x " + rows[8][1]), (7, "z " + rows[9][1]), (None, rows[7][1]), (1002, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    passed = []

    def counted(df, keys, names):
        got = sieved(df, keys, names)
        passed.append((df.count(), got.count(), keys.join(got, names, "left_anti").count()))
        return got
    sieved = near_dedup.sieved
    monkeypatch.setattr(near_dedup, "sieved", counted)
    plans, written = {}, near_dedup.written

    def seen(df, name):
        plans[name] = _initial_plan(spark, df)
        return written(df, name)
    monkeypatch.setattr(near_dedup, "written", seen)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, 2).collect()}
    assert {d: c for d, c in got.items() if d != c} == {1000: 7, 1001: 8, 9: 7}
    assert len(passed) == 3 and all(before > 300 and after < 20 and not lost for before, after, lost in passed)
    for name, at, wide in (("near", "f1", "sketch"), ("clustered", "f1", "sketch"), ("members", "did", "text")):
        lines = plans[name].splitlines()
        dealt = [x for x in lines if "hashpartitioning(" + at in x]
        # from an exchange down to the scan of the wide column, the bitmap is asked in between
        wide_scans = [i for i, x in enumerate(lines) if "Scan" in x and wide + "#" in x and "__map" not in x]
        asked = [i for i, x in enumerate(lines) if "getbit" in x or "bit_get" in x]
        assert dealt and asked and wide_scans, (name, plans[name])
        first = next(i for i, x in enumerate(lines) if "hashpartitioning(" + at in x and i < asked[0] and asked[0] - i < 5)
        assert first < asked[0] < max(wide_scans), (name, plans[name])


def test_a_sieve_loses_no_key(spark):
    from regspark.llm.tables import sieved
    table = spark.range(-5000, 5000).selectExpr("id as a", "nullif(id, 3) as b", "cast(id as string) as text")
    keys = table.where("a % 10 = 0 or a = 3").select("a", "b")
    for bits in (1 << 25, 70_001, 9, 1):                   # few bits: rows pass, none is lost
        got = {r.a: r.text for r in sieved(table, keys, ["a", "b"], bits).collect()}
        assert set(got) >= {r.a for r in keys.collect()} and all(t == str(a) for a, t in got.items())
        assert len(got) < 1100 if bits == 1 << 25 else len(got) == 10_000 if bits == 1 else True
    assert sieved(table, keys.limit(0), ["a", "b"]).count() == 0
    assert sieved(table, keys, ["a"]).columns == table.columns


def test_near_dedup_of_the_pipeline_deals_the_texts_once(spark):
    import corpus_pipeline
    rows = [(None, "a b c d e f g"), (0, "a b c d e f g"), (0, "a b c d e f g"), (3, "other words all of them here"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(None, "a b c d e f g"), (0, "a b c d e f g"), (3, "other words all of them here"), (None, None)], key=repr)
    with_text = [x for x in _initial_plan(spark, kept).splitlines() if "Exchange hashpartitioning" in x and "xxhash64" not in x]
    assert len([x for x in with_text if "__id" in x]) == 2 and not [x for x in with_text if "doc_id" in x]


def _initial_plan(spark, df):
    """The physical plan of ``df`` without broadcasts, before it runs."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_lm_state_is_kept_as_bytes(spark):
    """A word's lists reach the tasks whole, also when its customers lie in several batches."""
    import pyarrow as pa
    from regspark.llm.language_model import CONTEXTS, STATE, _first_seats, _held, _row, _tops, learn
    table = spark.createDataFrame([("the cat of the hat and the rat",), ("of cat and of dog",)], "text string")
    state = learn(table).state
    assert {f.dataType.simpleString() for f in state.schema.fields} == {"bigint", "binary"} and ", n binary" in STATE
    rows = [(-5, 3, 2), (-5, 17, 4), (1, 40, 1), (1, 2, 9), (1, 18, 7), (8, 0, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i:i + 2])], ["wid", "room", "n"]) for i in (0, 2, 4)]
    got = {}
    for batch in _first_seats(batches):
        row, rooms, n, t, ts, _ = _row(batch)
        tops = _tops(batch, _held(row, rooms.astype(int), batch.num_rows))
        for i, w in enumerate(batch["wid"].to_pylist()):
            got[w] = [x[row == i].tolist() for x in (rooms, n, t, ts)] + [np.flatnonzero(tops[i]).tolist()]
    assert got == {-5: [[3, 17], [2, 4], [2, 1], [0, 0], [1, 3]], 1: [[2, 18, 40], [9, 7, 1], [9, 1, 1], [0, 0, 0], [2, 8]],
                   8: [[0], [1], [1], [0], [0]]}
    assert tops.shape[1] == CONTEXTS


@pytest.mark.parametrize("head", [100_000, 12])
def test_lm_rare_preceding_words_have_restaurants(spark, monkeypatch, head):
    """What follows a word is learned also of words under one token in 10,000, listed or not; a context's
    probabilities sum to one."""
    import regspark.llm.language_model as lm
    monkeypatch.setattr(lm, "HEAD", head)
    filler = [f"fill{i % 10}" for i in range(60_000)]
    np.random.default_rng(3).shuffle(filler)
    train = [" ".join(filler), *["alpha betaa"] * 2, *["gamma delta"] * 2, "alpha delta", "gamma sigma", "gamma sigma"]
    words = sorted({w for t in train for w in t.split()}) + ["unseen", ""]
    probes = [" ".join(x for x in (p, w) if x) for p in ("alpha", "gamma", "fill3", "") for w in words]
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 != 1], [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [*zip(ids[0], train), *zip(ids[1], probes)]
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda t: kept.append(learn(t)) or kept[-1])
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    score = {t: got[i] for i, t in zip(ids[1], probes)}
    assert score["alpha betaa"] > score["gamma betaa"] + 1 and score["gamma sigma"] > score["alpha sigma"] + 1
    # a word's probability at a text's start, in class 0: all words here are long
    lexicon, models = kept[0].lexicon, kept[0].models
    at_start = {r.key: 10 ** r.logs[list(r.contexts).index(0)] for r in lm.model_table(kept[0]).collect()}
    at_start = {w: at_start[int(n)] for w, n in zip(words, lexicon.numbers([w.encode() for w in words])) if w != "unseen"}
    at_start["unseen"] = sum(m.unseen()[0] for m in models) / len(models)
    assert sum(at_start.values()) == pytest.approx(1, rel=1e-4)
    for p in ("alpha", "gamma", "fill3"):
        # score(p w) = start(p) + after(p, w) + after(w, end), and score(w) = start(w) + after(w, end)
        after = [10 ** (score[f"{p} {w}"] - score[w] + math.log10(at_start[w] / at_start[p])) for w in words if w]
        assert sum(after) + 10 ** (score[p] - math.log10(at_start[p])) == pytest.approx(1, rel=1e-3)
