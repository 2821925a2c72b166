"""DuckDB SQL equivalents of the registered queries (the independent correctness oracle).

Column names match the Spark queries exactly.  Tables are the driver's views.
"""

from __future__ import annotations

from regspark.schemas import DIMENSION_NAMES

def _padded(c: str) -> str:
    """Zero-padded to eight characters; printf keeps longer keys whole."""
    return f"printf('%08d', {c})"


_NAME = "concat(p_name, ' ', cast(p_partkey // 16 as varchar))"
_EMPRE = (f"select distinct {_padded('p_partkey')} as cnpj_emp, {_NAME} as razao_emp, "
          "p_retailprice as cap_soc_emp{snap} from part")
_ESTA = (f"select distinct {_padded('p_partkey')} as cnpj, {_NAME} as fantasia, "
         "p_brand as cnae{snap} from part")
_SOC = f"select distinct {_padded('s_suppkey')} as cnpj_soc, s_name as nome_socio" + "{snap} from supplier"


def _snap(c: str) -> str:
    return f", case when {c} % 2 = 0 then '2023-05' else '2025-01' end as snapshot"


JOINED = f"""
with empre as ({_EMPRE.format(snap='')}),
     esta as ({_ESTA.format(snap='')}),
     soc as ({_SOC.format(snap='')})
select * from empre join esta on razao_emp = fantasia
left join soc on substring(cnpj, 1, 7) = substring(cnpj_soc, 1, 7)
"""

JOINED_SKEWED = f"""
with empre as ({_EMPRE.format(snap='')}),
     esta as ({_ESTA.format(snap='')}),
     soc as (select distinct case when s_nationkey < 8 then '00000001'
                                  else {_padded('s_suppkey')} end as cnpj_soc,
                             s_name as nome_socio from supplier)
select * from empre join esta on razao_emp = fantasia
left join soc on substring(cnpj, 1, 7) = substring(cnpj_soc, 1, 7)
"""

JOINED_BY_SNAPSHOT = f"""
with empre as ({_EMPRE.format(snap=_snap('p_size'))}),
     esta as ({_ESTA.format(snap=_snap('p_size'))}),
     soc as ({_SOC.format(snap=_snap('s_nationkey'))})
select empre.*, esta.cnpj, esta.fantasia, esta.cnae, soc.cnpj_soc, soc.nome_socio
from empre join esta on empre.razao_emp = esta.fantasia and empre.snapshot = esta.snapshot
left join soc on substring(esta.cnpj, 1, 7) = substring(soc.cnpj_soc, 1, 7)
             and empre.snapshot = soc.snapshot
"""

_HREF_RAW = r"""regexp_extract_all(
       regexp_replace(html, '(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>)', '', 'g'),
       '(?i)<a(?:\s+[^\s"''<>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?)*?\s+href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)"""
_HREF_VALUE = r"""replace(replace(replace(replace(replace(
       case when regexp_matches(raw, '^("[^"]*"|''[^'']*'')$')
            then regexp_replace(raw, '^["'']|["'']$', '', 'g') else raw end,
       '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')"""
_LINKS = f"""(select page_id, url, href from
   (select page_id, url, {_HREF_VALUE} as href from
      (select page_id, url, unnest({_HREF_RAW}) as raw from pages))
   where href is not null and href <> '')"""

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# --- fixed values: column lists of the driver tables (for the schema report) ------------
_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
# DuckDB type name -> Spark simpleString
_TYPE_MAP = ("case typeof({c}) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' "
             "when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' "
             "when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' "
             "else lower(typeof({c})) end")


def _schema_report() -> str:
    parts = []
    for t in _TABLES:
        for i, c in enumerate(_COLUMNS[t]):
            parts.append(
                f"select '{t}' as table_name, {i + 1} as position, '{c}' as column_name, "
                f"(select {_TYPE_MAP.format(c=c)} from {t} limit 1) as data_type, "
                f"(select count(*) from {t}) as n_rows, (select count({c}) from {t}) as n_non_null")
    return "\nunion all\n".join(parts)


_EVENT_ARCHIVE = "concat(upper(substr(event_type, 1, 1)), lower(substr(event_type, 2)), cast(user_id % 10 as varchar), '.zip')"
_WANTED = """(select 'data' as kind, t.table_type, cast(s.shard as integer) as shard,
             concat(t.table_type, cast(s.shard as varchar), '.zip') as archive_name
      from (select distinct concat(upper(substr(event_type, 1, 1)), lower(substr(event_type, 2))) as table_type from events) t,
           (select range as shard from range(10)) s)"""
_WANTED_ALL = _WANTED[:-1] + " union all " + " union all ".join(
    f"select 'dimension', '{d}', cast(null as integer), '{d}.zip'" for d in DIMENSION_NAMES) + ")"
# an archive is listed (present) if its number of events is no multiple of 2 (is one of 3)
_LISTING = f"(select {_EVENT_ARCHIVE} as archive_name from events group by 1 having count(*) % 2 = 1)"
_PRESENT = f"(select {_EVENT_ARCHIVE} as archive_name from events group by 1 having count(*) % 3 = 0)"

_URL_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_URL_SCHEME = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
_BASE_PATH = r"regexp_replace(url, '[?#].*$', '')"

_PART_SNAP = "select *, case when p_size % 2 = 0 then '2023-05' else '2025-01' end as snapshot from part"
_CUST_SNAP = ("select *, case when c_nationkey % 2 = 0 then '2023-05' else '2025-01' end as snapshot "
              "from customer")
# one archive per (snapshot, shard) of part; shard = p_size mod 10, snapshot = its parity
_PART_ARCHIVES = ("select distinct concat('Part', cast(p_size % 10 as varchar), '-', "
                  "case when p_size % 2 = 0 then '2023-05' else '2025-01' end, '.zip') as archive_name, "
                  "cast(p_size % 10 as integer) as shard from part")

_SECTION = """case when d between 1 and 3 then 'A' when d between 5 and 9 then 'B' when d between 10 and 33 then 'C'
    when d = 35 then 'D' when d between 36 and 39 then 'E' when d between 41 and 43 then 'F' when d between 45 and 47 then 'G'
    when d between 49 and 53 then 'H' when d between 55 and 56 then 'I' when d between 58 and 63 then 'J'
    when d between 64 and 66 then 'K' when d = 68 then 'L' when d between 69 and 75 then 'M' when d between 77 and 82 then 'N'
    when d = 84 then 'O' when d = 85 then 'P' when d between 86 and 88 then 'Q' when d between 90 and 93 then 'R'
    when d between 94 and 96 then 'S' when d = 97 then 'T' when d = 99 then 'U' end"""

ORACLES: dict[str, str] = {
    "changed_shards": f"select * from ({_PART_SNAP}) where p_size % 10 <> 9",
    # of the odd sizes' shards Part1 is removed and Part7 stays truncated
    "republished_archives": "select * from part where p_size % 10 not in (1, 7)",
    "registry_job_repaired_shard": JOINED_BY_SNAPSHOT,
    "registry_job_emptied_snapshot": f"select * from ({JOINED_BY_SNAPSHOT}) where snapshot = '2023-05'",
    "registry_job_mended_rejects": "select 'before' as phase, count(*) as n from supplier union all select 'after', 0",
    "incremental_distinct": "select distinct l_suppkey, l_linenumber, l_returnflag, l_linestatus from lineitem",
    "bucketed_partner_join": f"""select c_custkey, c_name, o_orderkey, o_custkey, o_totalprice
        from customer left join orders
        on substring({_padded('c_custkey')}, 1, 7) = substring({_padded('o_custkey')}, 1, 7)""",
    "footer_row_counts": "\nunion all\n".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in _TABLES),
    "footer_snapshot_counts": f"""select 'part' as table_name, snapshot, count(*) as n_rows
        from (select p_partkey{_snap('p_size')} from part) group by snapshot""",
    "footer_column_counts": "\nunion all\n".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, count({c}) as n_values from {t}"
        for t in _TABLES for c in _COLUMNS[t]),
    "indexed_union": """select row_number() over (order by p_size % 2, p_size % 10, p_partkey) - 1 as index, * from part""",
    "scan_quoted_breaks": "select * from documents",
    "conversion_unreadable_file": """select 'part' as table_name, 'partial' as status, count(*) as n_rows,
          cast(1 as bigint) as n_failed, count(*) as n_stored from part where p_size % 10 <> 7""",
    "code_lists": """select p_partkey, concat(p_size % 25, ',', p_size * 7 % 30) as codes,
          concat(coalesce(a.n_name, '?'), '|', coalesce(b.n_name, '?')) as names
        from part left join nation a on a.n_nationkey = p_size % 25 left join nation b on b.n_nationkey = p_size * 7 % 30""",
    "segment_levels": f"""with deep as (select printf('%03d', s_suppkey * 37 % 1000) as prefix, min(printf('S%02d', s_nationkey)) as s
            from supplier group by 1),
          codes as (select code, cast(substring(code, 1, 2) as integer) as d from
            (select printf('%07d', p_partkey * 7919 % 10000000) as code from part)),
          named as (select code, {_SECTION} as section from codes)
        select case when s is not null then 3 when section is not null then 2 end as level,
          coalesce(s, section) as segment, count(*) as n
        from named left join deep on prefix = substring(code, 1, 3) group by 1, 2""",
    "registry_job_archives": JOINED_BY_SNAPSHOT,
    "registry_job_rerun_snapshot": JOINED_BY_SNAPSHOT,
    "registry_job_rejects": f"""select 'socios' as table_name, snapshot, 'MalformedLine' as error_class, count(*) as n
          from (select 1{_snap('s_nationkey')} from supplier) group by snapshot
        union all select 'empre', snapshot, 'BadZipFile', 1 from (select distinct 1{_snap('p_size')} from part)""",
    "conversion_file_status": f"""select 'part' as table_name, snapshot, concat('Part', cast(p_size % 10 as varchar)) as shard_name,
          'ok' as status, count(*) as n_rows, cast(0 as bigint) as n_bad
        from (select p_size{_snap('p_size')} from part) group by 2, 3""",
    "segment_of_code": f"""select p_partkey, code, {_SECTION} as segment from
        (select *, cast(substring(code, 1, 2) as integer) as d from
          (select p_partkey, printf('%07d', p_partkey * 7919 % 10000000) as code from part))""",
    "clean_registry_columns": """select p_name as razao_emp, printf('%08d', p_partkey) as cnpj_emp,
          cast(p_retailprice as decimal(18, 2)) as cap_soc_emp,
          case when p_size % 5 = 0 then null else date '2020-01-01' + cast(p_size as integer) end as dat_ini_at,
          case when p_type = 'PROMO' then null else p_type end as port_emp from part""",
    "categorised_companies": f"""select j.snapshot, {_SECTION} as segment, concat('Cnaes ', cast(p.p_size as varchar)) as cnae_desc,
          count(*) as n_rows, count(distinct cnpj_emp) as n_companies
        from ({JOINED_BY_SNAPSHOT}) j join (select *, p_size * 2 - 1 as d from part) p on j.cnpj = printf('%08d', p.p_partkey)
        group by 1, 2, 3""",
    "listing_to_plan": f"""with names as (select concat(upper(substr(w, 1, 1)), lower(substr(w, 2)), '0.zip') as archive_name
            from (select regexp_extract(href, '([A-Za-z]+)[^A-Za-z]*$', 1) as w from {_LINKS}
                  where starts_with(href, '/') or starts_with(href, 'http'))),
          types as (select distinct replace(archive_name, '0.zip', '') as table_type from names)
        select 'data' as kind, table_type, cast(range as integer) as shard,
          concat(table_type, cast(range as varchar), '.zip') as archive_name,
          case when range > 0 then 'missing' when n > 1 then 'extract' else 'download_extract' end as action
        from types, range(10) left join (select archive_name, count(*) as n from names group by 1) c
             on c.archive_name = concat(table_type, '0.zip')""",
    "company_partner_join": JOINED,
    "registry_job_csv": f"select *, '2025-01' as snapshot from ({JOINED}) t",
    "joined_row_count": f"select count(*) as n_rows from ({JOINED}) t",
    "joined_counts_by_cnae": f"select cnae, count(*) as n, count(cnpj_soc) as n_m from ({JOINED}) t group by cnae",
    "joined_counts_by_snapshot": f"""select snapshot, cnae, count(*) as n, count(cnpj_soc) as n_m
        from ({JOINED_BY_SNAPSHOT}) t group by snapshot, cnae""",
    "join_by_snapshot": JOINED_BY_SNAPSHOT,
    "skewed_partner_join": JOINED_SKEWED,
    "name_inner_join": f"""with empre as ({_EMPRE.format(snap='')}), esta as ({_ESTA.format(snap='')})
        select * from empre join esta on razao_emp = fantasia""",
    "prefix_left_join": f"""select c_custkey, c_name, o_orderkey, o_custkey, o_totalprice
        from customer left join orders
        on substring({_padded('c_custkey')}, 1, 7) = substring({_padded('o_custkey')}, 1, 7)""",
    "prefix_match_counts": f"""select c_custkey, count(o_orderkey) as n from customer left join orders
        on substring({_padded('c_custkey')}, 1, 7) = substring({_padded('o_custkey')}, 1, 7)
        group by c_custkey""",
    "prefix_left_join_int_keys": """select count(*) as n from supplier left join nation
        on substring(cast(s_suppkey as varchar), 1, 1) = substring(cast(n_nationkey as varchar), 1, 1)""",
    "padded_keys": """with k as (select o_orderkey, cast(o_orderkey + pow(10, 6 + o_orderkey % 4) as bigint) as key from orders)
        select o_orderkey, printf('%08d', key) as padded, substring(printf('%08d', key), 1, 7) as prefix from k""",
    "dedup_full_row": "select * from lineitem union select * from lineitem",
    "dedup_effect": """select n_before, n_after, n_before - n_after as n_removed from
        (select (select 2 * count(*) from lineitem) as n_before,
                (select count(*) from (select * from lineitem union select * from lineitem)) as n_after)""",
    "row_counts": "\nunion all\n".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in _TABLES),
    "preview_rows": "select * from orders order by o_orderkey limit 10",
    "schema_report": _schema_report(),
    "extract_links": f"select page_id, href from {_LINKS}",
    "filter_prefix_any": f"select page_id, href from {_LINKS} where starts_with(href, '/de') or starts_with(href, '/th') or starts_with(href, '/Th')",
    "filter_suffix": f"select page_id, href from {_LINKS} where ends_with(href, 'ion') and not ends_with(href, 'tion')",
    "filter_contains": f"""select page_id, href, contains(href, 'The') as has_kw, contains(lower(href), 'the') as has_kw_ci
        from {_LINKS} where contains(lower(href), 'the')""",
    "filter_in_list": "select p_partkey, p_name, p_brand from part where p_brand in ('Brand#1', 'Brand#7', 'Brand#13', 'Brand#22')",
    "resolve_links": f"""select page_id, href, case
          when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href
          when starts_with(href, '//') then concat({_URL_SCHEME}, ':', href)
          when starts_with(href, '/') then concat({_URL_ORIGIN}, href)
          when href = '' then url
          when starts_with(href, '?') then concat({_BASE_PATH}, href)
          when starts_with(href, '#') then concat(regexp_replace(url, '#.*$', ''), href)
          when length({_BASE_PATH}) = length({_URL_ORIGIN}) then concat({_URL_ORIGIN}, '/', href)
          else concat(regexp_replace({_BASE_PATH}, '[^/]*$', ''), href) end as resolved
        from {_LINKS}""",
    "path_parts": r"""select page_id, host, bn as base_name,
          case when ext = '' then bn else regexp_replace(bn, '\.[^.]*$', '') end as stem,
          ext as extension
        from (select page_id, host, bn, regexp_extract(bn, '^\.*[^.].*(\.[^.]*)$', 1) as ext
              from (select page_id,
                           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) as host,
                           regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) as bn
                    from pages))""",
    "archive_names": """select p_partkey,
          concat(p_type, cast(p_size % 10 as varchar), '.zip') as archive_name,
          concat(p_type, cast(p_size % 10 as varchar), '-', '2025-01', '.zip') as local_name,
          concat('202501', '_', lower(substr(p_type, 1, 4))) as out_prefix,
          replace(concat(replace(p_name, ' ', '_'), '.csv'), '.csv', '-pq.parquet') as parquet_name,
          trim(p_brand, '#') as brand_trim
        from part""",
    "wanted_manifest": f"select * from {_WANTED_ALL}",
    "wanted_by_snapshot": f"""select w.*, s.snapshot,
          concat(replace(w.archive_name, '.zip', ''), '-', s.snapshot, '.zip') as local_name,
          concat('https://host/dados/', s.snapshot, '/', w.archive_name) as url
        from {_WANTED} w, (select unnest(['2023-05', '2025-01']) as snapshot) s""",
    "manifest_available": f"select * from {_WANTED} w where archive_name in (select archive_name from {_LISTING})",
    "manifest_missing": f"select * from {_WANTED} w where archive_name not in (select archive_name from {_LISTING})",
    "ingest_plan": f"""select w.*, case when p.archive_name is not null then 'extract'
                                   when l.archive_name is not null then 'download_extract'
                                   else 'missing' end as action
        from {_WANTED} w left join {_LISTING} l on w.archive_name = l.archive_name
                         left join {_PRESENT} p on w.archive_name = p.archive_name""",
    "route_archives": f"""select archive_name, case when kind = 'dimension' then 'dimension' else 'data' end as route
        from {_WANTED_ALL}""",
    "lookup_dimensions": """select c_custkey, n_name as nation_name, r_name as region_name
        from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""",
    "segment_counts": """select r_name, c_mktsegment, count(*) as n, count(distinct c_nationkey) as k
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        group by r_name, c_mktsegment""",
    "clean_fields": """select o_orderkey, cast(o_totalprice as decimal(18, 2)) as total,
          cast(o_orderdate as date) as order_date, o_orderpriority as priority from orders""",
    "scan_headerless_csv": "select * from part",
    "scan_inferred_csv": """select cast(p_partkey as integer) as p_partkey, p_name, p_brand, p_type, p_size,
          p_retailprice from part""",
    "scan_shards": "select * from part",
    "scan_snapshots": _PART_SNAP,
    "scan_optional_input": "select * from supplier",
    "union_shards": _PART_SNAP,
    "rename_positional": "select * from part",
    "scan_positional_columns": """select cast(c_custkey as varchar) as _c0, c_name as _c1,
          cast(c_nationkey as varchar) as _c2, cast(c_acctbal as varchar) as _c3, c_mktsegment as _c4
        from customer""",
    "scan_latin1_csv": "select * from documents",
    "scan_skip_bad_rows": "select * from customer where c_mktsegment <> 'BUILDING'",
    "bad_row_rejects": "select count(*) as n_rejected from customer where c_mktsegment = 'BUILDING'",
    "load_dimension": "select cast(n_nationkey as varchar) as code, n_name as description from nation",
    "parquet_roundtrip": _CUST_SNAP,
    "csv_to_parquet": _PART_SNAP,
    "conversion_status": """select 'part' as table_name, 'ok' as status, count(*) as n_rows from part
        union all select 'supplier', 'ok', count(*) from supplier
        union all select 'socios', 'failed', cast(null as bigint)""",
    "export_joined": JOINED,
    "scan_zip_archives": "select * from part",
    "zip_rejects": f"""select replace(archive_name, '.zip', '-truncated.zip') as archive_name,
          'BadZipFile' as error_class from ({_PART_ARCHIVES}) a where shard = 9""",
    "first_member_per_archive": f"""select archive_name, concat('Part', cast(shard as varchar), '.csv') as member
        from ({_PART_ARCHIVES}) a""",
    "incremental_shards": _PART_SNAP,
    "incremental_archives": "select * from part",
}
