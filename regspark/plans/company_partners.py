"""Companies → establishments → partners: the registry's end-to-end join.

    dedup(companies)  ⋈name  dedup(establishments)  ⟕prefix7  dedup(partners)

Both joins are N:M.  :func:`company_partners` returns the joined rows;
:func:`company_partner_counts` returns their number (optionally per group) without
producing a single pair: it weights every establishment by the number of companies with
its name and by ``max(1, partners with its key prefix)``, so a hot name or prefix costs
one aggregated row instead of a quadratic fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions.keys import prefix_key
from regspark.operators.dedup import dedup_full_row
from regspark.operators.joins import equi_join, name_join, prefix_left_join, rename_collisions


def _snap_key(snapshot_col: str, key) -> "F.Column":
    """``snapshot + U+0001 + key``; null when either is null, so null keys never match.

    Snapshot labels never contain U+0001, so the composite compares exactly like the pair.
    """
    return F.concat(F.col(snapshot_col), F.lit("\u0001"), key)


def _renamed(name: str, renamed_df: DataFrame, suffix: str) -> str:
    """Name of ``name`` after :func:`rename_collisions` (suffixed when it collided)."""
    for _ in range(len(renamed_df.columns) + 1):
        if name in renamed_df.columns:
            return name
        name += suffix
    raise KeyError(name)


def company_partners(empre: DataFrame, esta: DataFrame, socios: DataFrame, *,
                     name_left: str = "razao_emp", name_right: str = "fantasia",
                     key_left: str = "cnpj", key_right: str = "cnpj_soc",
                     prefix_len: int = 7, key_width: int | None = None,
                     snapshot_col: str | None = None, dedup: bool = True,
                     collision_suffix: str = "_soc", hot_rows: int | None = 1_000_000) -> DataFrame:
    """The joined rows: companies + establishments + partners (left, unmatched kept).

    ``snapshot_col`` (present in all three inputs) adds snapshot equality to both joins,
    so several snapshots are processed in one run.  Right-side names that collide with
    the left side get ``collision_suffix``.  Partner-key prefixes with more than
    ``hot_rows`` partners are salted (see :func:`regspark.operators.joins.equi_join`);
    ``hot_rows=None`` turns that off.
    """
    if dedup:
        empre, esta, socios = dedup_full_row(empre), dedup_full_row(esta), dedup_full_row(socios)
    skew = {"hot_rows": hot_rows}
    if snapshot_col:
        # snapshot becomes part of the join key, so partitions never mix snapshots
        empre = empre.withColumn("__name_key", _snap_key(snapshot_col, F.col(name_left)))
        esta = esta.withColumn("__name_key", _snap_key(snapshot_col, F.col(name_right)))
        esta = esta.withColumnRenamed(snapshot_col, "__snap_esta")
        first = name_join(empre, esta, "__name_key", "__name_key") \
            .drop("__name_key").drop("__snap_esta")
        # both sides now carry the snapshot; compare it with the prefix in one key
        socios = rename_collisions(first, socios, collision_suffix)
        snap_r = _renamed(snapshot_col, socios, collision_suffix)
        rk_name = _renamed(key_right, socios, collision_suffix)
        lk = _snap_key(snapshot_col, prefix_key(key_left, prefix_len, key_width))
        rk = _snap_key(snap_r, prefix_key(rk_name, prefix_len, key_width))
        return equi_join(first, socios, lk, rk, "left", **skew).drop(snap_r)
    # inner name join: AQE splits skewed partitions of either side on its own
    first = name_join(empre, esta, name_left, name_right)
    socios = rename_collisions(first, socios, collision_suffix)
    rk_name = _renamed(key_right, socios, collision_suffix)
    return prefix_left_join(first, socios, key_left, rk_name, prefix_len, key_width, **skew)


def company_partner_counts(empre: DataFrame, esta: DataFrame, socios: DataFrame, *,
                           group_by: list[str] | None = None,
                           name_left: str = "razao_emp", name_right: str = "fantasia",
                           key_left: str = "cnpj", key_right: str = "cnpj_soc",
                           prefix_len: int = 7, key_width: int | None = None,
                           snapshot_col: str | None = None, dedup: bool = True) -> DataFrame:
    """Row count of :func:`company_partners` (``n``) and of its rows with a partner (``n_m``).

    ``group_by`` names establishment columns to count per group.  ``snapshot_col`` (in all
    three inputs) counts per snapshot: it is part of both keys and of the groups.  Only
    aggregated, one-row-per-key frames are joined, so the work is linear in the inputs.
    """
    if dedup:
        empre, esta, socios = dedup_full_row(empre), dedup_full_row(esta), dedup_full_row(socios)
    group_by = list(group_by or [])
    name_l, name_r = F.col(name_left), F.col(name_right)
    prefix_l, prefix_r = prefix_key(key_left, prefix_len, key_width), prefix_key(key_right, prefix_len, key_width)
    if snapshot_col:
        group_by = [snapshot_col] + [c for c in group_by if c != snapshot_col]
        name_l, name_r, prefix_l, prefix_r = (_snap_key(snapshot_col, k) for k in (name_l, name_r, prefix_l, prefix_r))
    per_name = empre.groupBy(name_l.alias("__name")).agg(F.count(F.lit(1)).alias("__w"))
    per_prefix = (socios.select(prefix_r.alias("__p"))
                  .where(F.col("__p").isNotNull())
                  .groupBy("__p").agg(F.count(F.lit(1)).alias("__m")))
    e = esta.select(*group_by, name_r.alias("__name"), prefix_l.alias("__p"))
    weighted = (e.join(per_name, "__name", "inner")
                .join(per_prefix, "__p", "left")
                .select(*group_by, "__w", F.coalesce("__m", F.lit(0)).alias("__m")))
    return weighted.groupBy(*group_by).agg(
        # products as decimals: two bigint counts could overflow
        F.sum(F.col("__w").cast("decimal(19,0)") * F.greatest(F.col("__m"), F.lit(1)).cast("decimal(19,0)"))
        .cast("bigint").alias("n"),
        F.sum(F.col("__w").cast("decimal(19,0)") * F.col("__m").cast("decimal(19,0)")).cast("bigint").alias("n_m"),
    )
