"""Retail tables as views over the TPC-H-like test tables.

One SQL text per view serves both engines: ``{name}`` is a DataFrame for Spark
and a plain table name for the SQL twin.  Every view reads whole tables; where a
join should miss, one side spells the code of one brand or type differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocklens import LabelRule, StockRules
from stocklens.names import BRANCH_WORD, HOUSE_WORD

BASE_TABLES = ("part", "supplier", "nation", "lineitem", "orders", "customer")

VIEWS = {
    "dim_item": """
        select p_partkey as item_id, p_name as referencia, p_brand as codigo_marca,
               'BC' || cast(p_partkey as string) as codigo_barra,
               'Marca ' || p_brand as nombre_marca, p_name || ' ' || p_brand as nombre,
               'Fab ' || substr(p_brand, 7, 1) as fabricante,
               p_type as category_id, p_type as nombre_categoria
        from {part}""",
    "dim_category": """
        select distinct p_type as category_id, substr(p_type, 1, 2) as codigo_sublinea,
               p_type as nombre_sublinea, 'Cat ' || p_type as nombre_categoria_principal
        from {part}""",
    "dim_store": """
        select n_nationkey as store_id, n_name as nombre_tienda from {nation}""",
    "fact_stock": """
        select l_partkey as item_id, s_nationkey as store_id,
               case when p_brand = 'Brand#7' then cast(0 as double) else l_quantity - 5 end as existencia,
               l_extendedprice as precio_detal,
               case when l_discount = 0.01 then cast(0 as double)
                    when l_discount < 0.05 then l_extendedprice
                    else l_extendedprice * (1 - l_discount) end as precio_promocion,
               case when l_discount >= 0.05 then 1 else 0 end as promocion,
               l_linestatus as status
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {part} on l_partkey = p_partkey""",
    "movement_line": """
        select l_orderkey as numero, 'BC' || cast(l_partkey as string) as codigo_barra,
               l_quantity as cantidad
        from {lineitem}""",
    "movement_header": """
        select o_orderkey as numero, o_orderdate as fecha, o_orderstatus as status,
               o_custkey as codigo_recibe
        from {orders}""",
    "destination": """
        select c_custkey as codigo from {customer}""",
    "op_item": """
        select case when p_brand = 'Brand#9' then 'XC' else 'BC' end
               || cast(p_partkey as string) as codigo_barra, p_name as referencia,
               p_brand as codigo_marca, p_name || ' ' || p_brand as nombre,
               p_type as codigo_categoria, 'F' || substr(p_brand, 7, 1) as codigo_fabricante
        from {part}""",
    "op_category": """
        select distinct p_type as codigo, 'Cat ' || p_type as nombre from {part}""",
    "maker": """
        select distinct 'F' || substr(p_brand, 7, 1) as codigo,
               'Fab ' || substr(p_brand, 7, 1) as nombre
        from {part}""",
    "brand_lookup": """
        select distinct case when p_brand = 'Brand#3' then 'Brand#03' else p_brand end as codigo,
               'Marca ' || p_brand as nombre
        from {part}""",
    "line_lookup": """
        select distinct case when p_type = 'LARGE' then 'LARX' else substr(p_type, 1, 4) end as codigo,
               'Linea ' || substr(p_type, 1, 4) as nombre
        from {part}""",
    "discount_catalog": """
        select p_name || p_brand || case when p_brand = 'Brand#5' then '*' else '' end as concatenar,
               case when max(p_size) <= 10 then '' else cast(max(p_size) as string) || '%' end as pct_descuento
        from {part} group by p_name, p_brand""",
}

STATUSES = ("F",)

RULES = StockRules(
    regions=(
        *[LabelRule(f"R{i} - {HOUSE_WORD}", (i,)) for i in range(4)],
        LabelRule(f"R0 - {BRANCH_WORD}", (6, 9, 12, 15, 18, 21)),
        LabelRule(f"R1 - {BRANCH_WORD}", (4, 7, 10, 13, 16, 19)),
        LabelRule(f"R2 - {BRANCH_WORD}", (5, 8, 11, 14, 17, 20)),
    ),
    owners=(
        LabelRule("Owner A", ("ECONOMY", "MEDIUM")),
        LabelRule("Owner B", ("STANDARD",)),
        LabelRule("Owner C", ("PROMO",)),
    ),
)

# Store names of the test data by store id; they fix the pivot columns.
STORES = {i: f"NATION_{i}" for i in range(25)}
HOUSE_REGIONS = sorted({RULES.region_of(i) for i in STORES if HOUSE_WORD in RULES.region_of(i)})
BRANCH_STORES = sorted(s for i, s in STORES.items() if BRANCH_WORD in RULES.region_of(i))
STORE_LABELS = (
    sorted(f"{RULES.region_of(i)} - {s}" for i, s in STORES.items() if HOUSE_WORD in RULES.region_of(i))
    + sorted(f"{RULES.region_of(i)} - {s}" for i, s in STORES.items() if BRANCH_WORD in RULES.region_of(i)))

# More than 80 pivot columns: each store once per status and promotion flag.
WIDE_LABELS = [f"{label}/{status}/{flag}" for label in STORE_LABELS for status in ("F", "O") for flag in (0, 1)]
# All columns of the base tables, by how their values are written for checksums.
BASE_COLUMNS = {
    "part": {"p_partkey": "", "p_name": "", "p_brand": "", "p_type": "", "p_size": "", "p_retailprice": "fraction"},
    "supplier": {"s_suppkey": "", "s_name": "", "s_nationkey": "", "s_acctbal": "fraction"},
    "nation": {"n_nationkey": "", "n_name": "", "n_regionkey": ""},
    "lineitem": {"l_orderkey": "", "l_partkey": "", "l_suppkey": "", "l_linenumber": "", "l_quantity": "fraction",
                 "l_extendedprice": "fraction", "l_discount": "fraction", "l_tax": "fraction", "l_returnflag": "",
                 "l_linestatus": "", "l_shipdate": "time"},
    "orders": {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "", "o_totalprice": "fraction", "o_orderdate": "time",
               "o_orderpriority": ""},
    "customer": {"c_custkey": "", "c_name": "", "c_nationkey": "", "c_acctbal": "fraction", "c_mktsegment": ""},
}


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE_TABLES}


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All fixture views as DataFrames, keyed as ``stocklens`` expects."""
    base = base_tables(spark, sf_dir)
    views = {}
    for name, text in VIEWS.items():
        used = {n: df for n, df in base.items() if "{" + n + "}" in text}
        views[name] = spark.sql(text, **used)
    return views
