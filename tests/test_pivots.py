from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import stocklens as sl
from data import random_snapshot, snapshot_frame, snapshot_row
from stocklens.names import FIXED_ATTRIBUTES, SNAPSHOT_COLUMNS


def as_dicts(rows):
    return [dict(zip(SNAPSHOT_COLUMNS, r)) for r in rows]


def null_first(row):
    return tuple((row[a] is not None, row[a]) if row[a] is not None else (False, "") for a in FIXED_ATTRIBUTES)


def brute_all_stores(rows):
    """Item -> (attributes, sums by label, house total, branch total), rows without stock left out."""
    groups = defaultdict(list)
    for r in as_dicts(rows):
        if r["Concatenar"] is not None:
            groups[r["Concatenar"]].append(r)
    out = {}
    for key, members in groups.items():
        sums = defaultdict(float)
        for r in members:
            if r["Region"] is not None and r["NombreTienda"] is not None:
                sums[f"{r['Region']} - {r['NombreTienda']}"] += r["Existencia_Total"]
        house = sum(v for k, v in sums.items() if "Casa Matriz" in k)
        branch = sum(v for k, v in sums.items() if "Sucursales" in k)
        if house or branch:
            first = min(members, key=null_first)
            out[key] = (tuple(first[a] for a in FIXED_ATTRIBUTES), dict(sums), house, branch)
    return out


def test_all_stores_against_brute_force(spark):
    rows = random_snapshot(1)
    got = sl.pivot_all_stores(snapshot_frame(spark, rows))
    want = brute_all_stores(rows)
    data = {r["Concatenar"]: r.asDict() for r in got.collect()}
    assert set(data) == set(want)
    labels = [c for c in got.columns if " - " in c]
    house = sorted(c for c in labels if "Casa Matriz" in c)
    assert labels == house + sorted(c for c in labels if c not in house)
    assert got.columns[:13] == list(FIXED_ATTRIBUTES)
    assert got.columns[-4:] == ["Sucursal_Total", "Casa_matriz_Total", "Porcentaje_Existencia_CasaMatriz",
                                "Porcentaje_Existencia_Sucursales"]
    for key, (attrs, sums, h, b) in want.items():
        r = data[key]
        assert tuple(r[a] for a in FIXED_ATTRIBUTES) == attrs
        assert all(r[c] == sums.get(c, 0) for c in labels)
        assert (r["Casa_matriz_Total"], r["Sucursal_Total"]) == (h, b)
        assert r["Casa_matriz_Total"] == sum(r[c] for c in house)
        assert r["Porcentaje_Existencia_CasaMatriz"] == f"{round(h / (h + b) * 100, 2)}%"


@pytest.mark.parametrize("fn,word,label,total", [
    (sl.pivot_branches, "Sucursales", "NombreTienda", "Sucursal_Total"),
    (sl.pivot_main_house, "Casa Matriz", "Region", "Casa_matriz_Total")])
def test_scoped_pivots_against_brute_force(spark, fn, word, label, total):
    rows = [r for r in random_snapshot(2)]
    sums, attrs = defaultdict(lambda: defaultdict(float)), set()
    for r in as_dicts(rows):
        if r["Region"] and word in r["Region"] and r["Concatenar"] is not None:
            attrs.add(tuple(r[a] for a in FIXED_ATTRIBUTES))
            if r[label] is not None:
                sums[r["Concatenar"]][r[label]] += r["Existencia_Total"]
    got = fn(snapshot_frame(spark, rows))
    labels = sorted({k for s in sums.values() for k in s})
    assert got.columns == [*FIXED_ATTRIBUTES, *labels, total]
    want = sorted(((*a, *[sums[a[0]].get(x, 0.0) for x in labels], sum(sums[a[0]].values()))
                   for a in attrs if sum(sums[a[0]].values()) > 0), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_global_share_counts_repeated_rows(spark):
    rows = [snapshot_row("r1", region="A - Casa Matriz", stock=1.0, discount="0%"),
            snapshot_row("r1", region="B - Casa Matriz", stock=1.0, discount="5%"),
            snapshot_row("r2", region="A - Casa Matriz", stock=4.0)]
    df = snapshot_frame(spark, rows)
    share = {(r["Referencia"], r["Descuento"]): r["Porcentaje_Existencia_CasaMatriz"]
             for r in sl.pivot_main_house_share(df).collect()}
    assert share == {("r1", "0%"): "25.0%", ("r1", "5%"): "25.0%", ("r2", "0%"): "50.0%"}
    once = sl.pivot_main_house_share(df, one_per_item=True).collect()
    assert sorted(r["Porcentaje_Existencia_CasaMatriz"] for r in once) == ["33.33%", "66.67%"]
    given = sl.pivot_main_house_share(df, total=8).collect()
    assert sorted(r["Porcentaje_Existencia_CasaMatriz"] for r in given) == ["25.0%", "25.0%", "50.0%"]
    zero = sl.pivot_main_house_share(df.withColumn("Existencia_Total", F.lit(0.0))).collect()
    assert [r["Porcentaje_Existencia_CasaMatriz"] for r in zero] == ["0%"] * 3


def test_store_named_like_the_main_house_counts_on_both_sides(spark):
    df = snapshot_frame(spark, [snapshot_row(region="A - Sucursales", store="Casa Matriz 2", stock=3.0),
                                snapshot_row(region="Sin region", store="T9", stock=5.0)])
    row = sl.pivot_all_stores(df).collect()[0]
    assert (row["Casa_matriz_Total"], row["Sucursal_Total"]) == (3.0, 3.0)
    assert "Sin region - T9" not in row.asDict()


def test_empty_scope_keeps_the_schema(spark):
    df = snapshot_frame(spark, [snapshot_row(region="Sin region")])
    assert sl.pivot_branches(df, ["T1"]).columns[-2:] == ["T1", "Sucursal_Total"]
    assert sl.pivot_branches(df, ["T1"]).count() == sl.pivot_all_stores(df).count() == 0


def test_columns_absent_from_the_data_are_zero(spark):
    df = snapshot_frame(spark, [snapshot_row(store="T.1", stock=2.0)])
    row = sl.pivot_branches(df, ["T2", "T.1"]).collect()[0]
    assert (row["T.1"], row["T2"], row["Sucursal_Total"]) == (2.0, 0.0, 2.0)


def test_awkward_store_names(spark):
    names = ["it's", "back\\slash", "tick`", 'quo"te', "a.b c"]
    df = snapshot_frame(spark, [snapshot_row(store=n, stock=float(i + 1)) for i, n in enumerate(names)])
    row = sl.pivot_branches(df, names).collect()[0]
    assert [row[n] for n in names] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert [sl.pivot_all_stores(df).collect()[0][f"A - Sucursales - {n}"] for n in names] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_decimal_stock(spark):
    df = snapshot_frame(spark, [snapshot_row("r", stock=1.5), snapshot_row("s", region="A - Casa Matriz", stock=2.25)])
    df = df.withColumn("Existencia_Total", F.col("Existencia_Total").cast("decimal(18,3)"))
    out = sl.pivot_all_stores(df)
    assert out.schema["Sucursal_Total"].dataType.simpleString().startswith("decimal")
    rows = {r["Referencia"]: r for r in out.collect()}
    assert float(rows["r"]["Sucursal_Total"]) == 1.5 and float(rows["r"]["A - Casa Matriz - T1"]) == 0
    assert rows["s"]["Porcentaje_Existencia_CasaMatriz"] == "100.0%"
    assert sl.pivot_main_house_share(df).collect()[0]["Porcentaje_Existencia_CasaMatriz"] == "100.0%"


def test_column_errors(spark):
    df = snapshot_frame(spark, [snapshot_row()])
    with pytest.raises(ValueError, match="Region"):
        sl.pivot_main_house(df.drop("Region"))
    with pytest.raises(ValueError, match="clash"):
        sl.pivot_branches(df, ["Concatenar"])
    spark.conf.set("spark.sql.pivotMaxValues", "0")
    try:
        with pytest.raises(ValueError, match="pivot columns"):
            sl.pivot_branches(df)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_columns_from_the_store_dimension(spark):
    stores = spark.createDataFrame([(2003, "X"), (1, "Y"), (1032, "Z"), (9, "W"), (1029, None)],
                                   "store_id int, nombre_tienda string")
    rules = sl.DEFAULT_RULES
    assert sl.store_columns(stores, rules, "Todo") == [
        "Valencia Casa Matriz - X", "Margarita - Sucursales - Z", "Oriente - Sucursales - Y"]
    assert sl.store_columns(stores, rules, "Solo Sucursales") == ["Y", "Z"]
    assert sl.store_columns(stores, rules, "Solo Casa Matriz") == ["Valencia Casa Matriz"]


def test_attribute_choice_is_the_smallest_with_null_first(spark):
    df = snapshot_frame(spark, [snapshot_row(discount="5%", promo=0), snapshot_row(discount=None, promo=1),
                                snapshot_row(discount="0%", promo=1)])
    row = sl.item_attributes(df).collect()[0]
    assert (row["Descuento"], row["Promocion"]) == (None, 1)
    assert sl.item_attributes(df, one_per_item=False).count() == 3


def test_given_total_rounds_correctly(spark):
    df = spark.createDataFrame([(1.115,)], "v double")
    assert sl.global_share(df, "v", 100.0, "p").first()["p"] == "1.11%"
    both = spark.createDataFrame([(1.115,), (98.885,)], "v double")
    assert {r["p"] for r in sl.global_share(both, "v", out="p").collect()} == {"1.12%", "98.88%"}
