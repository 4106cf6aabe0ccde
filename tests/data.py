"""Small random snapshots and star schemas for brute-force checks."""

import random

from stocklens.names import SNAPSHOT_COLUMNS

SNAPSHOT_DDL = ", ".join(
    f"{c} " + ("double" if c.startswith("Existencia") else "int" if c == "Promocion" else "string")
    for c in SNAPSHOT_COLUMNS)

REGIONS = ("A - Casa Matriz", "B - Casa Matriz", "A - Sucursales", "B - Sucursales", "Sin region", None)


def snapshot_row(ref="r", brand="b", region="A - Sucursales", store="T1", stock=1.0, discount="0%", promo=0,
                 fecha="01/02/2024", **other):
    row = dict.fromkeys(SNAPSHOT_COLUMNS)
    key = None if ref is None and brand is None else (ref or "") + (brand or "")
    row.update(Concatenar=key, Referencia=ref, CodigoMarca=brand, NombreMarca="m", Nombre="n", Fabricante="f",
               CodigoSubLinea="ec", Linea="l", Encargado="e", Descuento=discount, Promocion=promo,
               NombreCategoria="c", Fecha=fecha, Region=region, NombreTienda=store, Existencia_Total=stock)
    row.update(other)
    return tuple(row[c] for c in SNAPSHOT_COLUMNS)


def random_snapshot(seed, n=400):
    rng = random.Random(seed)
    return [snapshot_row(
        ref=rng.choice(["r1", "r2", "r3", None]), brand=rng.choice(["b1", "b2"]), region=rng.choice(REGIONS),
        store=rng.choice(["T1", "T2", "T.3", "Casa Matriz X", None]), stock=float(rng.choice([0, 0, 1, 2, 7])),
        discount=rng.choice(["0%", "5%", None]), promo=rng.choice([0, 1]),
        fecha=rng.choice(["01/02/2024", "31/12/2023"])) for _ in range(n)]


def snapshot_frame(spark, rows):
    return spark.createDataFrame(rows, SNAPSHOT_DDL)
