import random
from datetime import datetime

import duckdb
import pytest

import stocklens as sl
from oracle import normal
from workload.oracles import CTES

RULES = sl.StockRules(
    regions=(sl.LabelRule("A - Casa Matriz", (0,)), sl.LabelRule("A - Sucursales", (1, 2))),
    owners=(sl.LabelRule("Owner A", ("L0",)),))


def star(seed, n=300):
    """A star schema with NULL codes, colliding keys and items sharing a description."""
    rng = random.Random(seed)
    refs = [("AB", "C"), ("A", "BC"), ("A", "BC"), ("R", None), (None, "B"), ("S", "B"), ("S", "B")]
    items = [(i, r, b, f"BC{min(i, 5)}", "m", "n", "f", i % 3, "c") for i, (r, b) in enumerate(refs)]
    items.append((7, "N", "B", "BC7", "m", "n", "f", 99, "c"))  # category unknown
    facts = [(rng.randrange(9), rng.randrange(4), float(rng.choice([-1, 0, 0, 1, 5])),
              rng.choice([0.0, 10.0, 20.0, None]), rng.choice([0.0, 10.0, 15.0, None]), rng.choice([0, 1]),
              rng.choice(["F", "O", None])) for _ in range(n)]
    lines = [(rng.randrange(30), f"BC{rng.randrange(8)}", rng.choice([1.0, -1.0, 2.0, 3.0, None])) for _ in range(120)]
    return {
        "dim_item": (items, "item_id int, referencia string, codigo_marca string, codigo_barra string, "
                     "nombre_marca string, nombre string, fabricante string, category_id int, nombre_categoria string"),
        "dim_category": ([(i, f"s{i}", f"L{i}", f"C{i}") for i in range(3)],
                         "category_id int, codigo_sublinea string, nombre_sublinea string, "
                         "nombre_categoria_principal string"),
        "dim_store": ([(i, f"T{i}") for i in range(4)], "store_id int, nombre_tienda string"),
        "fact_stock": (facts, "item_id int, store_id int, existencia double, precio_detal double, "
                       "precio_promocion double, promocion int, status string"),
        "movement_line": (lines, "numero int, codigo_barra string, cantidad double"),
        "movement_header": ([(i, datetime(2024, 1 + i % 3, 1 + i), rng.choice(["F", "F", "P"]), i % 4)
                             for i in range(25)],
                            "numero int, fecha timestamp, status string, codigo_recibe int"),
        "destination": ([(0,), (1,), (2,)], "codigo int"),
        "op_item": ([(f"BC{i}", r, b, "n", f"K{i % 3}", "F1") for i, (r, b) in enumerate(refs)],
                    "codigo_barra string, referencia string, codigo_marca string, nombre string, "
                    "codigo_categoria string, codigo_fabricante string"),
        "op_category": ([("K0", "x"), ("K1", "y"), ("K2", "z")], "codigo string, nombre string"),
        "maker": ([("F1", "Fab")], "codigo string, nombre string"),
        "brand_lookup": ([("C", "Marca C")], "codigo string, nombre string"),
        "line_lookup": ([("K0", "Linea")], "codigo string, nombre string"),
    }


def expected(tables):
    """The snapshot SQL of the fixture over these tables, with their own rules."""
    con = duckdb.connect()
    for name, (rows, ddl) in tables.items():
        names = [c.split()[0] for c in ddl.split(", ")]
        kinds = [c.split()[1] for c in ddl.split(", ")]
        con.execute(f"create table {name} ({', '.join(f'{n} {k}' for n, k in zip(names, kinds))})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(names))})", [list(r) for r in rows])
    ctes = {k: CTES[k] for k in ("unidos", "por_tienda", "movimientos", "ultimo", "foto")}
    foto = ctes["foto"].replace("referencia || codigo_marca", "coalesce(referencia, '') || coalesce(codigo_marca, '')")
    start, end = foto.index("case when store_id"), foto.index("end as Region") + 3
    region = foto[start:end]
    foto = foto.replace(region, "case when store_id = 0 then 'A - Casa Matriz' "
                        "when store_id in (1, 2) then 'A - Sucursales' else 'Sin region' end")
    start, end = foto.index("case when nombre_sublinea"), foto.index("end as Encargado") + 3
    foto = foto.replace(foto[start:end], "case when nombre_sublinea = 'L0' then 'Owner A' else 'Sin encargado' end")
    # a row-value IN is NULL-aware; the pairs are compared one by one instead
    foto = foto.replace("where (referencia, codigo_marca) in\n              (select (referencia, codigo_marca) from "
                        "por_tienda where existencia > 0)",
                        "q where exists (select 1 from por_tienda p2 where p2.existencia > 0 and "
                        "p2.referencia = q.referencia and p2.codigo_marca = q.codigo_marca)")
    ctes["foto"] = foto
    return con.execute("with " + ", ".join(f"{k} as ({v})" for k, v in ctes.items()) + " select * from foto").df()


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_with_nulls_collisions_and_shared_descriptions(spark, seed):
    tables = star(seed)
    frames = {n: spark.createDataFrame(r, d) for n, (r, d) in tables.items()}
    want = normal(expected(tables))
    got = sl.stock_snapshot(frames, RULES, statuses=("F",)).toPandas()
    assert len(want) > 20
    assert normal(got).equals(want)
    # items 1 and 2 are one item with different bar codes, 5 and 6 share everything
    joined = sl.stock_by_item_store(frames)
    keys = ["referencia", "codigo_marca", "codigo_barra", "codigo_sublinea", "store_id", "promocion", "status"]
    assert joined.count() == joined.select(*keys).distinct().count()


def test_pair_key_does_not_multiply(spark):
    frames = {n: spark.createDataFrame(r, d) for n, (r, d) in star(1).items()}
    grain = ["Referencia", "CodigoMarca", "CodigoBarra", "CodigoSubLinea", "NombreTienda", "Promocion", "Status"]
    pair = sl.stock_snapshot(frames, RULES, statuses=("F",), key="pair")
    assert pair.count() == pair.select(*grain).distinct().count()
    both = sl.stock_snapshot(frames, RULES, statuses=("F",))
    assert both.count() > both.select(*grain).distinct().count()
