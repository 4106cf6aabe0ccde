import os

import pytest
from pyspark.sql import functions as F

import stocklens as sl
from data import random_snapshot, snapshot_frame
from stocklens.names import SNAPSHOT_COLUMNS, WAREHOUSE_LAYOUT
from stocklens.session import scratch_path
from stocklens.sources.catalog import numbered_lines
from stocklens.sources.tables import adopt, jdbc_reader


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def pairs(df):
    return sorted((str(a), str(b)) for a, b in df.collect())


def test_catalog_header_anywhere_in_the_first_rows(spark, tmp_path):
    write(tmp_path, "a.csv", "Promo 2024;;\nzona;norte;\n\nNombre; Concatenar ;% Descuento\n"
                             "x;k1;10%\r\n\"y;z\";\"k\"\"2\";\n;;\n")
    write(tmp_path, "b.csv", "% Descuento;otra;Concatenar\n0.5;q;k3\n")
    got = sl.load_catalog(spark, str(tmp_path))
    assert got.columns == ["Concatenar", "% Descuento"]
    # columns are told apart by name, whatever their order
    assert pairs(got) == [("k\"2", "None"), ("k1", "10%"), ("k3", "0.5")]


def test_catalog_files_without_header_or_names_fail_by_name(spark, tmp_path):
    write(tmp_path, "good.csv", "Concatenar;% Descuento\nk;1\n")
    write(tmp_path, "bare.csv", "a;b\nc;d\n")
    with pytest.raises(Exception, match="no header in the first 50 lines of .*bare.csv"):
        sl.load_catalog(spark, str(tmp_path)).collect()
    write(tmp_path, "bare.csv", "Concatenar ref;Descuento final\nc;d\n")
    with pytest.raises(Exception, match="no column .* in the header of .*bare.csv"):
        sl.load_catalog(spark, str(tmp_path)).collect()


def test_catalog_given_header_and_fallback_positions(spark, tmp_path):
    write(tmp_path, "a.csv", "t\nConcatenar;h1;h2;h3;h4;h5;% Descuento\nk1;1;2;3;4;5;7%\nk2;1\n")
    assert pairs(sl.load_catalog(spark, str(tmp_path), header_row=1)) == [("k1", "7%"), ("k2", "None")]
    # fewer than two marked cells: the fallback positions apply, by name as well
    write(tmp_path, "a.csv", "x\nConcatenar;b\nk1;9\n")
    with pytest.raises(Exception, match="no column '% Descuento'"):
        sl.load_catalog(spark, str(tmp_path), header_row=1, fallback=(0, 1)).collect()


def test_catalog_header_below_the_scanned_rows(spark, tmp_path):
    write(tmp_path, "a.csv", "x;y\n" * 50 + "Concatenar;% Descuento\nk;1\n")
    with pytest.raises(Exception, match="no header"):
        sl.load_catalog(spark, str(tmp_path)).collect()
    assert sl.load_catalog(spark, str(tmp_path), scan_rows=51).count() == 1


def test_catalog_lines_of_many_quoted_cells(spark, tmp_path):
    wide = ";".join(['"a;b"'] * 10_000)
    write(tmp_path, "a.csv", f"Concatenar;% Descuento\nk;1;{wide}\n")
    assert pairs(sl.load_catalog(spark, str(tmp_path))) == [("k", "1")]


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    write(tmp_path, "long.txt", "\n".join(lines))
    write(tmp_path, "short.txt", "a\n\nb\n")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    long = {r["line"]: r["value"] for r in got if r["file"].endswith("long.txt")}
    assert [long[i] for i in range(3000)] == lines
    assert sorted((r["line"], r["value"]) for r in got if r["file"].endswith("short.txt")) == [(0, "a"), (1, ""), (2, "b")]


def test_catalog_contract(spark):
    df = spark.createDataFrame([("k", 0.23)], "` Concatenar` string, `% Descuento ` double")
    assert [tuple(r) for r in sl.as_catalog(df).collect()] == [("k", "0.23")]
    with pytest.raises(ValueError, match="% Descuento"):
        sl.as_catalog(df.select("` Concatenar`"))


def test_export_round_trip_and_empty_refusal(spark, tmp_path):
    view = sl.pivot_main_house(snapshot_frame(spark, random_snapshot(3)))
    path = sl.export_view(view, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == view.columns and back.count() == view.count()
    target = str(tmp_path / "none")
    with pytest.raises(sl.EmptyViewError):
        sl.export_view(view.filter("false"), target)
    assert not os.path.exists(target)


def test_export_in_one_job_without_copies(spark, tmp_path):
    """One job, nothing persisted, no staging left; modes keep, add and replace; an empty view changes nothing."""
    made = spark.sparkContext.accumulator(0)
    df = spark.range(0, 40, 1, 4)
    seen = df.rdd.map(lambda r: (made.add(1), r[0])[1]).map(lambda x: (x,)).toDF("id long")
    path = str(tmp_path / "out")
    sl.export_view(seen, path, "csv")
    assert made.value == 40 and seen.storageLevel.useDisk is False
    with pytest.raises(FileExistsError):
        sl.export_view(df, path, "csv")
    sl.export_view(df, path, "csv", "append")
    assert spark.read.option("header", True).csv(path).count() == 80
    for mode in ("append", "overwrite"):
        with pytest.raises(sl.EmptyViewError):
            sl.export_view(df.filter("id > 99"), path, "csv", mode)
    assert spark.read.option("header", True).csv(path).count() == 80
    sl.export_view(df, path, "csv", "overwrite")
    assert spark.read.option("header", True).csv(path).count() == 40
    with pytest.raises(Exception, match="stop"):
        sl.export_view(df.select(F.raise_error(F.lit("stop"))), str(tmp_path / "bad"), "parquet")
    with pytest.raises(ValueError, match="mode"):
        sl.export_view(df, path, "csv", "ignore")
    assert os.listdir(tmp_path) == ["out"]


def test_export_columns(spark):
    view = sl.pivot_all_stores(snapshot_frame(spark, random_snapshot(4)))
    data, branch = sl.split_columns(view.columns)
    assert "Casa_matriz_Total" in data and "Sucursal_Total" in branch
    out = sl.export_columns(view, ["Descuento", "Concatenar"], ["Sucursal_Total"])
    assert out.columns == ["Concatenar", "Descuento", "Sucursal_Total"]
    assert all(isinstance(v, str) for r in out.collect() for v in r)
    with pytest.raises(ValueError):
        sl.export_columns(view, ["Concatenar"], [])


def test_discount_report(spark):
    df = spark.createDataFrame([("k", None, "5%")], "Conoatenar string, Descuento string, Descuento_Catalogo string")
    assert [tuple(r) for r in sl.discount_report(df).collect()] == [("k", "", "5%")]
    with pytest.raises(ValueError, match="Descuento_Catalogo"):
        sl.discount_report(df.drop("Descuento_Catalogo"))


def test_tables_by_name_and_format(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "` id ` int, v string")
    for fmt in ("parquet", "orc", "json"):
        df.write.format(fmt).save(str(tmp_path / f"t.{fmt}"))
        assert sorted(sl.load_table(spark, "t", str(tmp_path), fmt).columns) == ["id", "v"]
    df.write.parquet(str(tmp_path / "plain"))
    assert sl.load_table(spark, "plain", str(tmp_path), "parquet").columns == ["id", "v"]
    df.createOrReplaceTempView("kept")
    assert sl.load_table(spark, "kept").columns == ["id", "v"]
    got = sl.load_sources(spark, str(tmp_path), "parquet", ["t", "plain"])
    assert {n: d.count() for n, d in got.items()} == {"t": 1, "plain": 1}


def test_database_reader_options(spark):
    jdbc_reader(spark, "jdbc:none", "t", partitionColumn="id", lowerBound=0, upperBound=9, numPartitions=4)
    with pytest.raises(ValueError, match="numPartitions"):
        jdbc_reader(spark, "jdbc:none", "t", partitionColumn="id", lowerBound=0, upperBound=9)
    for name in ("fact_stock", "db.dbo.MOVTRANSFERENCIAS"):
        with pytest.raises(ValueError, match="partitionColumn"):
            jdbc_reader(spark, "jdbc:none", name)


def test_warehouse_names_are_adopted(spark, tmp_path):
    for source, renames in WAREHOUSE_LAYOUT.values():
        have = [c for c in renames if c not in ("Correccion", "Observacion")]
        numeric = ("Existencia", "PrecioDetal", "PrecioPromocion", "Cantidad", "Promocion")
        spark.range(1).select(*[F.lit(1 if c in numeric else "1").alias(c.upper()) for c in have],
                              F.lit(0).alias("otra")) \
             .write.mode("overwrite").parquet(str(tmp_path / source))
    tables = sl.load_warehouse(spark, str(tmp_path), str(tmp_path), "parquet")
    assert set(tables["fact_stock"].columns) == {
        "item_id", "store_id", "existencia", "precio_detal", "precio_promocion", "promocion", "status"}
    snap = sl.stock_snapshot(tables, sl.DEFAULT_RULES, statuses=("1",))
    assert snap.columns == list(SNAPSHOT_COLUMNS)
    assert adopt(spark.range(1).toDF("NUMERO"), {"Numero": "numero", "Fecha": "fecha"}).columns == ["numero"]


def test_snapshot_is_loaded_once_and_refreshed(spark):
    loads = []

    def load():
        loads.append(1)
        return snapshot_frame(spark, random_snapshot(len(loads)))

    shared = sl.Snapshot(load)
    first = shared.view("Solo Sucursales").count()
    assert shared.pivot("Solo Sucursales") is shared.pivot("Solo Sucursales")
    assert shared.pivot("Solo Sucursales", 2023) is not shared.pivot("Solo Sucursales")
    direct = sl.stock_view(snapshot_frame(spark, random_snapshot(1)), "Solo Sucursales")
    assert direct.count() == first and len(loads) == 1
    kept = shared.persist()
    assert kept.storageLevel.useDisk
    shared.refresh()
    assert len(loads) == 2 and not kept.storageLevel.useMemory
    with pytest.raises(ValueError):
        shared.view(region="X")
    shared.release()


def test_scratch_folder_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
