"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
PROSE = " ".join(f"token{i}" for i in range(80))
CLASH = ["kept", "n_words", "copy", "seeds", "did", "key", "size", "shard", "score", "raw", "piece", "n", "ratio", "component_id"]
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (5, "two words"), (None, PROSE), (6, LONG), (7, PROSE),
        (8, PROSE), (9, "é ñ ß — “x”"), (10, "idiot " * 30), (11, PROSE + " tail"), (12, "another text under an id"), (12, "a second text under it")]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    return table.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(docs, none):
    from regspark.llm.quality_rules import compression_bands
    rows = compression_bands(docs).collect()
    assert len(rows) == len(ROWS) and compression_bands(none).count() == 0
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[1, None].ratio is None and not by[1, None].kept and by[1, None].reason == "base"
    assert by[7, PROSE].n_words == 80 and by[None, PROSE].kept == by[7, PROSE].kept
    assert {"lang", "copy"} <= set(compression_bands(docs).columns)


def test_near_dedup(docs, none):
    from regspark.llm.near_dedup import near_duplicates
    rows = near_duplicates(docs, 2).collect()
    assert len(rows) == len(ROWS) and near_duplicates(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].n_shingles, by[1][0].component_id, by[2][0].component_id) == (0, 1, 2)
    assert by[None][0].component_id is None and by[None][0].kept
    assert [by[i][0].component_id for i in (7, 8, 11)] == [7, 7, 7]
    assert [r.component_id for r in by[5] + by[12]] == [5, 5, 12, 12]


def test_substring_dedup(docs, none):
    from regspark.llm.substring_dedup import remove_repeats
    rows = remove_repeats(docs).collect()
    assert len(rows) == len(ROWS) and remove_repeats(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].text, by[1][0].n_words, by[2][0].text) == (None, 0, "")
    assert (by[7][0].n_removed, by[8][0].n_removed, by[None][0].n_removed) == (0, 80, 80)
    assert (by[11][0].n_removed, by[11][0].text) == (80, "tail")
    assert [(s.start, s.stop) for s in by[11][0].removed] == [(0, 80)]
    assert by[10][0].n_removed == 29 and by[6][0].n_removed > 50_000
    assert len({r.n_removed for r in by[5]}) == 1


def test_decontamination(spark, docs, none):
    from regspark.llm.decontaminate import contaminated
    items = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "two words"), (None, "word5 word6 word7 word8 word9 word10")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("kept", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(None, 1), (7, 1), (8, 1), (11, 1), (5, 4), (6, None)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench, slice_bytes=64).collect()} == got
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_packing(docs, none):
    from regspark.llm.packing import pack
    rows = pack(docs).collect()
    assert pack(none).count() == 0
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert [(r.length, r.start) for r in rows if r.doc_id in (1, 2, 3)] == [(1, 0)] * 3
    assert sum(r.doc_id == 5 for r in rows) == 2
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    assert all(n == 2048 for _, _, n in long[:-1]) and [s for _, s, _ in long] == [2048 * i for i in range(len(long))]


def test_sharding(docs, none):
    from regspark.llm.sharding import assign_shards
    got = assign_shards(docs, 3)
    rows = got.collect()
    assert len(rows) == len(ROWS) and assign_shards(none, 3).count() == 0
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {8}
    for s in {r.shard for r in rows}:
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert "lang" in got.columns and got.columns.count("size") == 1


def test_language_model(docs, none):
    from regspark.llm.language_model import score_texts
    rows = score_texts(docs).collect()
    assert len(rows) == len(ROWS) and score_texts(none).count() == 0
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert len({(r.n_tokens, r.score) for r in rows if r.doc_id == 5}) == 1
    assert all(r.score <= 0 for r in rows) and sum(r.doc_id is None for r in rows) == 1


def test_toxicity(spark, docs, none):
    from regspark.llm.toxicity import score_toxicity
    labels = spark.createDataFrame([(i, int(i == 10)) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(none, labels).count() == 0
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_urls(spark):
    from regspark.llm.url_filters import judge_urls
    urls = [(1, None), (2, ""), (3, "://"), (4, "http://h/" + "a/" * 3000), (4, "http://h/" + "a/" * 3000), (None, "http://x.com/")]
    table = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "n", "label")})
    assert judge_urls(table).count() == len(urls) and judge_urls(table.limit(0)).count() == 0


def test_chat(spark):
    from regspark.llm.chat_format import preference_format, preference_sides
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, "x"), (2, 1, "assistant", ""),
             (3, 0, "user", "y" * 100_000), (None, 0, "user", "z")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("a", F.lit(1))
    rows = {r.pair_id: r for r in preference_format(*preference_sides(table)).collect()}
    assert set(rows) >= {1, 2, 3} and rows[3].chosen == ""
    assert preference_format(*preference_sides(table.limit(0))).count() == 0


def test_chat_keeps_every_turn_and_finds_the_next_reply(spark):
    from regspark.llm.chat_format import next_ids, preference_format, preference_sides
    turns = [(5, 0, "user", "q5"), (5, 1, "assistant", "a5"), (5, 2, "user", "thanks"), (9, 0, "user", "no reply"),
             (40, 0, "user", "q40"), (40, 1, "assistant", "a40"), (40, 2, "tool", None), (1 << 40, 0, None, "r"),
             (1 << 40, None, "assistant", "null turn"), (1 << 40, 3, "assistant", "big")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chosen, rejected = preference_sides(table)
    assert chosen.count() == len(turns) and rejected.count() == len(turns) - 1      # the last one has no other reply
    rows = {r.pair_id: r for r in preference_format(chosen, rejected).collect()}
    assert "a5<|end|>" in rows[5].chosen and "a40<|end|>" in rows[5].rejected and rows[5].rejected.endswith("thanks<|end|>\n")
    assert "big<|end|>" in rows[40].rejected and rows[9].chosen == rows[9].rejected == ""
    assert [rows[5].rejected[a:b] for a, b in zip(rows[5].rejected_mask[::2], rows[5].rejected_mask[1::2])] == ["a40<|end|>\n"]
    ids = [-(1 << 63), -70000, -1, 0, 1, 8191, 8192, 1 << 26, (1 << 26) + 1, (1 << 63) - 1]
    got = {r.id: r.next for r in next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == dict(zip(ids, [*ids[1:], None]))
    assert next_ids(spark.createDataFrame([], "id long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from regspark.llm.tables import written
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    cols, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, path), "stage")
        assert docs.columns == cols
        assert 0 < docs.count() <= before
        before = docs.count()
    last = P.STAGES[-1][1](spark, docs, path)
    assert last.select("doc_id").distinct().count() == before
    odd = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "key": F.lit(1)})
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, odd, path).columns == odd.columns and stage(spark, odd.limit(0), path).count() == 0
    assert sum(r.doc_id in (7, 8, 11) for r in P.near_dedup(spark, odd, path).collect()) == 1


def test_pipeline_carries_columns_named_like_its_own(spark):
    import corpus_pipeline as P
    from regspark.llm.tables import written
    path = "/root/testdata/sf0.001"
    own = [*CLASH, "check", "firsts", "n_removed", "removed", "reason", "doc_key", "item_id", "text_key", "range_no"]
    odd = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "n_chars").withColumns(
        {c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in own})
    docs = odd
    for _, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, path), "clash")
        rows = docs.collect()
        assert docs.columns == odd.columns and rows
        assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in own)
    assert P.packing(spark, docs, path).count() > 0
