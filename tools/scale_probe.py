"""Measure how the headline plans scale with data size.

    python tools/scale_probe.py [--sf-dir DIR] [--factors 1,4,16] [--out docs/SCALING.md]

The sf inputs are replicated ``k`` times by Spark (``explode(sequence)``) with distinct,
replica-prefixed keys and replica-tagged names, so every replica is an independent
copy: the true output grows exactly ``k``-fold and any super-linear time is the plan's.
Replicated inputs are written as many files (``max(8, 2k)``), like real inputs, so the
scan is parallel.  Times are medians of two warm runs through the ``noop`` sink.
"""

from __future__ import annotations

import argparse
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--factors", default="1,4,16")
    ap.add_argument("--out", default=None)
    a = ap.parse_args()

    from pyspark.sql import functions as F
    from regspark.operators.dedup import dedup_full_row
    from regspark.plans.company_partners import company_partner_counts, company_partners
    from regspark.session import build_session, cut_lineage

    spark = build_session("local[8]", shuffle_partitions=16)
    part = spark.read.parquet(f"{a.sf_dir}/part.parquet")
    supp = spark.read.parquet(f"{a.sf_dir}/supplier.parquet")
    line = spark.read.parquet(f"{a.sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey")

    def replicate(df, k):
        # many files per input, as real inputs have (the test tables are one file each)
        out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__r"))
        return out.repartition(max(8, 2 * k))

    def key(col, r="__r"):
        return F.concat(F.lpad(F.col(r).cast("string"), 3, "0"), F.lpad(F.col(col).cast("string"), 8, "0"))

    rows = []
    for k in [int(x) for x in a.factors.split(",")]:
        p = replicate(part, k)
        empre = cut_lineage(p.where(F.col("p_type") == "PROMO").select(
            key("p_partkey").alias("cnpj_emp"), F.concat("p_name", F.lit("#"), "__r").alias("razao_emp"),
            F.col("p_retailprice").alias("cap_soc_emp")), spark, "probe-empre")
        esta = cut_lineage(p.where(F.col("p_type") == "ECONOMY").select(
            key("p_partkey").alias("cnpj"), F.concat("p_name", F.lit("#"), "__r").alias("fantasia"),
            F.col("p_brand").alias("cnae")), spark, "probe-esta")
        socios = cut_lineage(replicate(supp, k).select(
            key("s_suppkey").alias("cnpj_soc"), F.col("s_name").alias("nome_socio")), spark, "probe-socios")
        pairs = cut_lineage(replicate(line, k).select(
            (F.col("l_partkey") + F.col("__r").cast("bigint") * F.lit(10**9)).alias("l_partkey"), "l_suppkey"),
            spark, "probe-line")
        jobs = {
            "company_partner_join": lambda: company_partners(empre, esta, socios, prefix_len=10,
                                                             hot_rows=1_000_000),
            "joined_row_count": lambda: company_partner_counts(empre, esta, socios, prefix_len=10),
            "dedup_full_row": lambda: dedup_full_row(pairs),
        }
        for name, build in jobs.items():
            took = []
            for _ in range(3):
                t0 = time.perf_counter()
                build().write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - t0)
            n = build().count() if name != "company_partner_join" else None
            rows.append((k, name, statistics.median(took[1:]), empre.count(), n))
            print(k, name, round(statistics.median(took[1:]), 3), flush=True)
    spark.stop()

    base = {name: t for k, name, t, _, _ in rows if k == rows[0][0]}
    lines = ["# Scaling probe", "",
             f"Inputs of `{os.path.basename(a.sf_dir)}` replicated k times (independent copies); "
             "steady time per query on `local[8]` (median of two warm runs, `noop` sink).", "",
             "| k | query | seconds | × of k=1 time | companies |", "| --- | --- | --- | --- | --- |"]
    for k, name, t, n_emp, _ in rows:
        lines.append(f"| {k} | `{name}` | {t:.2f} | {t / base[name]:.1f} | {n_emp} |")
    text = "\n".join(lines) + "\n"
    if a.out:
        with open(a.out, "w") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main()
