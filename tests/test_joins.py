from pyspark.sql import functions as F

from conftest import plan, rows
from regspark.functions.keys import padded_key, prefix_key
from regspark.operators.joins import equi_join, name_join, prefix_left_join, rename_collisions
from regspark.plans.company_partners import company_partner_counts, company_partners
from regspark.schemas import EMPRE_COLUMNS, ESTA_COLUMNS, SOCIOS_COLUMNS, string_schema


def test_prefix_key_int_inference_collides_but_padding_does_not(spark):
    df = spark.createDataFrame([("01234567",), ("12345678",)], "k string")
    as_int = df.select(F.col("k").cast("bigint").alias("k"))
    # H1: inferred ints lose the zero padding, so both keys share the prefix 1234567
    assert sorted(r[0] for r in as_int.select(prefix_key("k", 7)).collect()) == ["1234567", "1234567"]
    assert sorted(r[0] for r in as_int.select(prefix_key("k", 7, width=8)).collect()) == ["0123456", "1234567"]
    assert sorted(r[0] for r in df.select(prefix_key("k", 7)).collect()) == ["0123456", "1234567"]
    assert df.select(padded_key(F.lit(42), 8)).first()[0] == "00000042"


def test_name_join_is_exact_and_n_to_m(spark):
    left = spark.createDataFrame([("1", "BETA"), ("2", "BETA"), ("3", "beta"), ("4", None)], "a string, n string")
    right = spark.createDataFrame([("x", "BETA"), ("y", "BETA"), ("z", "BETA "), ("w", None)], "b string, m string")
    out = name_join(left, right, "n", "m")
    # H4: case and trailing spaces matter, nulls never match; 2 x 2 pairs
    assert rows(out, ["a", "b"]) == [("1", "x"), ("1", "y"), ("2", "x"), ("2", "y")]
    norm = name_join(left, right, "n", "m", normalize=True)
    assert norm.count() == 3 * 3


def test_prefix_left_join_keeps_unmatched_and_fans_out(spark):
    esta = spark.createDataFrame([("12345670",), ("12345678",), ("99999990",), (None,)], "cnpj string")
    soc = spark.createDataFrame([("1234567X", "p1"), ("1234567Y", "p2")], "cnpj_soc string, nome string")
    out = prefix_left_join(esta, soc)
    got = rows(out, ["cnpj", "nome"])
    assert got == sorted([("12345670", "p1"), ("12345670", "p2"), ("12345678", "p1"), ("12345678", "p2"),
                          ("99999990", None), (None, None)], key=repr)
    # an equi-join on the prefix expressions, never a nested loop / cartesian product
    p = plan(out)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_prefix_join_on_integer_keys_casts_implicitly(spark):
    s = spark.createDataFrame([(12,), (25,), (7,)], "k bigint")
    n = spark.createDataFrame([(1,), (2,), (3,)], "j int")
    out = prefix_left_join(s, n, "k", "j", length=1)
    assert rows(out) == sorted([(7, None), (12, 1), (25, 2)], key=repr)


def test_salted_join_equals_plain_join(spark):
    # one key owns most right rows; salting must not change the answer
    left = spark.createDataFrame([(i % 5, f"l{i}") for i in range(40)] + [(None, "ln")], "k int, lv string")
    right = spark.createDataFrame([(0, f"r{i}") for i in range(300)] + [(i, f"s{i}") for i in range(1, 4)]
                                  + [(None, "rn")], "rk int, rv string")
    for how in ("inner", "left"):
        plain = equi_join(left, right, F.col("k"), F.col("rk"), how)
        salted = equi_join(left, right, F.col("k"), F.col("rk"), how, hot_rows=50)
        assert salted.count() == plain.count()
        assert rows(salted) == rows(plain)
    # salt copies by explode; no pairs, no union
    p = plan(equi_join(left, right, F.col("k"), F.col("rk"), "left", hot_rows=50))
    assert "Generate" in p and "Union" not in p and "NestedLoop" not in p and "Cartesian" not in p
    from regspark.operators.joins import hot_key_frame
    assert rows(hot_key_frame(right, F.col("rk"), 50)) == [(0, 6)]


def test_salting_spreads_equal_rows_of_a_hot_key(spark):
    left = spark.createDataFrame([(0, "l")], "k int, lv string")
    right = spark.range(400, numPartitions=8).select(F.lit(0).alias("rk"), F.lit("same").alias("rv"))
    assert equi_join(left, right, F.col("k"), F.col("rk"), "left", hot_rows=50).count() == 400


def test_keys_longer_than_the_width_are_kept(spark):
    df = spark.createDataFrame([(123456789,), (12345678,), (42,)], "k long")
    assert [r[0] for r in df.select(padded_key("k", 8)).collect()] == ["123456789", "12345678", "00000042"]
    assert [r[0] for r in df.select(prefix_key("k", 8, 8)).collect()] == ["12345678", "12345678", "00000042"]
    assert prefix_left_join(df.limit(2), df.limit(2).withColumnRenamed("k", "j"), "k", "j", 9, 8).count() == 2


def test_counts_per_snapshot_do_not_mix_snapshots(spark):
    e = spark.createDataFrame([("1", "A", "s1"), ("1", "A", "s2")], "k string, razao_emp string, snapshot string")
    f = spark.createDataFrame([("12345678", "A", "s1"), ("12345678", "A", "s2")], "cnpj string, fantasia string, snapshot string")
    p = spark.createDataFrame([("12345670", "s1"), ("12345671", "s2")], "cnpj_soc string, snapshot string")
    got = company_partner_counts(e, f, p, snapshot_col="snapshot")
    assert rows(got) == [("s1", 1, 1), ("s2", 1, 1)]


def test_rename_collisions_suffixes_right_side(spark):
    left = spark.createDataFrame([("BR",)], "pais string")
    right = spark.createDataFrame([("US", "x")], "pais string, other string")
    assert rename_collisions(left, right, "_soc").columns == ["pais_soc", "other"]


def _registry_fixture(spark):
    e = [("00000001", "ALFA", *["e"] * 5), ("00000001", "ALFA", *["e"] * 5),  # exact duplicate
         ("00000002", "BETA", *["e"] * 5), ("00000003", "BETA", *["e"] * 5)]
    es = []
    for cnpj, name, pais in [("12345670", "ALFA", "BR"), ("12345678", "BETA", "BR"),
                             ("55555550", "BETA", "BR"), ("77777770", "GAMA", "BR")]:
        row = dict.fromkeys(ESTA_COLUMNS, "x")
        row.update(cnpj=cnpj, fantasia=name, pais=pais)
        es.append(tuple(row[c] for c in ESTA_COLUMNS))
    so = []
    for cnpj, nome in [("1234567A", "p1"), ("1234567B", "p2"), ("1234567B", "p2")]:
        row = dict.fromkeys(SOCIOS_COLUMNS, "y")
        row.update(cnpj_soc=cnpj, nome_socio=nome, pais="US")
        so.append(tuple(row[c] for c in SOCIOS_COLUMNS))
    return (spark.createDataFrame(e, string_schema(EMPRE_COLUMNS)),
            spark.createDataFrame(es, string_schema(ESTA_COLUMNS)),
            spark.createDataFrame(so, string_schema(SOCIOS_COLUMNS)))


def test_company_partners_end_to_end(spark):
    empre, esta, socios = _registry_fixture(spark)
    out = company_partners(empre, esta, socios)
    assert len(out.columns) == 7 + 30 + 11 and len(set(out.columns)) == len(out.columns)
    assert "pais_soc" in out.columns  # H5
    # ALFA: 1 company (deduped) x 1 esta x 2 partners (deduped); BETA: 2 x (1 esta x 2 + 1 esta x 1)
    assert out.count() == 2 + 2 * 2 + 2 * 1
    assert out.where(F.col("cnpj_soc").isNull()).count() == 2  # 55555550 has no partner (H3)
    counts = company_partner_counts(empre, esta, socios).first()
    assert (counts["n"], counts["n_m"]) == (8, 6)
    salted = company_partners(empre, esta, socios, hot_rows=1)
    assert rows(salted) == rows(out)


def test_company_partners_by_snapshot(spark):
    empre, esta, socios = _registry_fixture(spark)
    tag = lambda df, s: df.withColumn("snapshot", F.lit(s))
    e2 = tag(empre, "2023-05").unionByName(tag(empre, "2025-01"))
    es2 = tag(esta, "2023-05").unionByName(tag(esta, "2025-01"))
    so2 = tag(socios, "2023-05")  # partners only in the first snapshot
    out = company_partners(e2, es2, so2, snapshot_col="snapshot")
    per = {r["snapshot"]: r["count"] for r in out.groupBy("snapshot").count().collect()}
    assert per == {"2023-05": 8, "2025-01": 5}


from hypothesis import given, settings, HealthCheck, strategies as st

_names = st.sampled_from(["ALFA", "BETA", "beta", "GAMA", None])
_keys = st.sampled_from(["12345670", "12345678", "55555550", "7777777A", None])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(e=st.lists(st.tuples(st.sampled_from(["1", "2", "3"]), _names), max_size=8),
       es=st.lists(st.tuples(_keys, _names, st.sampled_from(["c1", "c2"])), max_size=10),
       so=st.lists(st.tuples(_keys, st.sampled_from(["p1", "p2", "p3"])), max_size=12))
def test_counts_and_salting_agree_with_the_join(spark, e, es, so):
    empre = spark.createDataFrame(e, "cnpj_emp string, razao_emp string")
    esta = spark.createDataFrame(es, "cnpj string, fantasia string, cnae string")
    socios = spark.createDataFrame(so, "cnpj_soc string, nome_socio string")
    joined = company_partners(empre, esta, socios)
    salted = company_partners(empre, esta, socios, hot_rows=1)
    assert rows(salted) == rows(joined)
    by = {r["cnae"]: (r["n"], r["n_m"]) for r in company_partner_counts(empre, esta, socios, group_by=["cnae"]).collect()}
    want = {}
    for r in joined.collect():
        n, m = want.get(r["cnae"], (0, 0))
        want[r["cnae"]] = (n + 1, m + (r["cnpj_soc"] is not None))
    assert by == want
