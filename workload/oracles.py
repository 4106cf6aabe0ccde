"""ANSI-SQL twins of the registered queries, over the same test tables.

Each text is a chain of common table expressions ending in one SELECT.  The
twins follow the written meaning of an operator (windows, row numbers, ordered
picks), not the way the Spark plan computes it.
"""

from __future__ import annotations

import re

from stocklens.names import FIXED_ATTRIBUTES

from .fixtures import (
    BASE_COLUMNS, BRANCH_STORES, HOUSE_REGIONS, RULES, STORE_LABELS, VIEWS, WIDE_LABELS,
)

FIXED = ", ".join(FIXED_ATTRIBUTES)

# Every odd item but the first with the texts of the item before it.
SHARED = """dim_item as (
      select i.item_id, e.* exclude (item_id) from own_item i
      join own_item e on e.item_id = case when i.item_id % 2 = 1 and i.item_id > 1 then i.item_id - 1 else i.item_id end),
"""


# Three more pieces in every fact of one item in a hundred.
CHANGED = """fact_stock as (
      select * replace (case when item_id % 100 = 7 then existencia + 3 else existencia end as existencia) from own_stock),
"""


def _canonical(col: str, kind: str) -> str:
    """A value as text for its checksum: hundredths of fractions, times to the second."""
    return {"fraction": f"cast(cast(round({col} * 100) as bigint) as varchar)",
            "time": f"strftime({col}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"cast({col} as varchar)")


def _text_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _region(col: str) -> str:
    arms = " ".join(f"when {col} in ({', '.join(map(str, r.values))}) then '{r.label}'" for r in RULES.regions)
    return f"case {arms} else '{RULES.no_region}' end"


def _owner(col: str) -> str:
    arms = " ".join(f"when {col} in ({_text_list(r.values)}) then '{r.label}'" for r in RULES.owners)
    return f"case {arms} else '{RULES.no_owner}' end"


def _discount(price: str, promo: str) -> str:
    percent = f"cast(round((1 - {promo} / nullif({price}, 0)) * 100, 0) as int)"
    return (f"case when {promo} = 0 or {price} = 0 or {promo} = {price} then '0%' "
            f"else coalesce(cast({percent} as varchar), '') || '%' end")


def _share(part: str, total: str) -> str:
    """Correctly rounded percent text of a row total."""
    return (f"cast(case when {total} > 0 then cast(printf('%.2f', {part} / {total} * 100) as double) "
            f"else 0.0 end as varchar) || '%'")


def _global_share(part: str, total: str) -> str:
    return (f"case when {total} > 0 then cast(round_even({part} / {total} * 100 * 100, 0) / 100 as varchar) || '%' "
            f"else '0%' end")


def _given_share(part: str, total: str) -> str:
    """Percent text of a given total, correctly rounded."""
    return f"cast(cast(printf('%.2f', {part} / {total} * 100) as double) as varchar) || '%'"


def _pct(text: str) -> str:
    number = f"try_cast(trim(replace({text}, '%', '')) as double)"
    return f"coalesce(cast(cast(round_even({number}, 0) as bigint) as varchar) || '%', {text})"


def _sums(label: str, labels) -> str:
    return ", ".join(f"""sum(case when {label} = '{v}' then Existencia_Total else 0 end) as "{v}\"""" for v in labels)


def _names(labels) -> str:
    return ", ".join(f'"{v}"' for v in labels)


def _pivot_all(source: str) -> str:
    label = "Region || ' - ' || NombreTienda"
    return f"""
      select {FIXED}, {_names(STORE_LABELS)}, Sucursal_Total, Casa_matriz_Total,
             {_share('Casa_matriz_Total', '(Casa_matriz_Total + Sucursal_Total)')} as Porcentaje_Existencia_CasaMatriz,
             {_share('Sucursal_Total', '(Casa_matriz_Total + Sucursal_Total)')} as Porcentaje_Existencia_Sucursales
      from (select * from (select {FIXED}, row_number() over (partition by Concatenar order by
              Referencia nulls first, CodigoMarca nulls first, NombreMarca nulls first, Nombre nulls first,
              Fabricante nulls first, CodigoSubLinea nulls first, Linea nulls first, Encargado nulls first,
              Descuento nulls first, Promocion nulls first, NombreCategoria nulls first, Fecha nulls first) as rn
              from {source}) where rn = 1)
      join (select Concatenar as k, {_sums(label, STORE_LABELS)},
              sum(case when {label} like '%Casa Matriz%' then Existencia_Total else 0 end) as Casa_matriz_Total,
              sum(case when {label} like '%Sucursales%' then Existencia_Total else 0 end) as Sucursal_Total
            from {source} group by Concatenar) on Concatenar = k
      where not (Casa_matriz_Total = 0 and Sucursal_Total = 0)"""


def _pivot_scope(source: str, word: str, label: str, labels, total: str, positive: bool = True) -> str:
    return f"""
      select {FIXED}, {_names(labels)}, {total}
      from (select distinct {FIXED} from {source} where Region like '%{word}%')
      join (select Concatenar as k, {_sums(label, labels)}, sum(Existencia_Total) as {total}
            from {source} where Region like '%{word}%' group by Concatenar) on Concatenar = k
      {f'where {total} > 0' if positive else ''}"""


def _branches(source: str) -> str:
    return _pivot_scope(source, "Sucursales", "NombreTienda", BRANCH_STORES, "Sucursal_Total")


def _house(source: str, positive: bool = True) -> str:
    return _pivot_scope(source, "Casa Matriz", "Region", HOUSE_REGIONS, "Casa_matriz_Total", positive)


def _with_catalog(view: str) -> str:
    value = "coalesce(case when trim(c.Descuento_Catalogo) = '' then null else c.Descuento_Catalogo end, v.Descuento)"
    return (f"select v.*, {_pct(value)} as Descuento_Catalogo "
            f"from {view} v left join catalogo c on v.Concatenar = c.Concatenar")


def _flagged(view: str) -> str:
    return f"select *, count(*) over (partition by Concatenar, Descuento) > 1 as _dup_desc from {view}"


def _no_stock_cleared(source: str) -> str:
    return f"""
      select * replace (case when Existencia_Total <= 0 then 0 else Promocion end as Promocion,
                        case when Existencia_Total <= 0 then '0%' else Descuento end as Descuento)
      from {source}"""


CTES = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in VIEWS.items()}
CTES.update({
    "catalogo": "select concatenar as Concatenar, pct_descuento as Descuento_Catalogo from discount_catalog",
    "unidos": """
      select f.*, i.* exclude (item_id), c.* exclude (category_id), s.nombre_tienda
      from fact_stock f join dim_item i on f.item_id = i.item_id
      join dim_store s on f.store_id = s.store_id
      join dim_category c on i.category_id = c.category_id
      where f.existencia >= 0""",
    "por_tienda": """
      select referencia, codigo_marca, codigo_barra, nombre_marca, nombre, fabricante, codigo_sublinea,
             nombre_sublinea, nombre_categoria_principal, nombre_categoria, store_id, nombre_tienda,
             promocion, status, sum(existencia) as existencia, max(precio_detal) as precio_detal,
             max(precio_promocion) as precio_promocion
      from unidos group by all""",
    "etiquetado": f"""
      select coalesce(referencia, '') || coalesce(codigo_marca, '') as Concatenar,
             referencia as Referencia, codigo_marca as CodigoMarca, codigo_barra as CodigoBarra,
             {_region('store_id')} as Region, nombre_tienda as NombreTienda,
             existencia as Existencia_Total, promocion as Promocion, status as Status
      from por_tienda""",
    "movimientos": """
      select coalesce(item.referencia, '') || coalesce(item.codigo_marca, '') as Concatenar,
             item.codigo_barra as CodigoBarra, item.referencia as Referencia, item.codigo_marca as CodigoMarca,
             item.nombre as Nombre, maker.nombre as Fabricante, left(category.codigo, 4) as CategoriaCodigo,
             category.nombre as CategoriaNombre, brand.nombre as Marca, prefix.nombre as Linea,
             line.cantidad as Cantidad, line.numero as NumeroTransferencia, head.fecha as Fecha
      from movement_line line
      join movement_header head on head.numero = line.numero and head.status = 'F'
      join destination on destination.codigo = head.codigo_recibe
      join op_item item on item.codigo_barra = line.codigo_barra
      join op_category category on category.codigo = item.codigo_categoria
      join maker on maker.codigo = item.codigo_fabricante
      left join brand_lookup brand on brand.codigo = item.codigo_marca
      left join line_lookup prefix on prefix.codigo = left(category.codigo, 4)
      where line.cantidad <> 1 and line.cantidad <> -1""",
    "ultimo": """
      select * exclude (rn, Fecha), strftime(Fecha, '%d/%m/%Y') as Fecha from (
        select Concatenar, CodigoBarra, Referencia, CodigoMarca, Cantidad, NumeroTransferencia, Fecha,
               row_number() over (partition by Referencia, CodigoMarca
                 order by Fecha desc nulls last, NumeroTransferencia desc nulls last,
                          Concatenar, CodigoBarra, Cantidad) as rn
        from movimientos) where rn = 1""",
    "foto": f"""
      select p.Concatenar, p.Referencia, p.CodigoBarra, p.NombreMarca, p.CodigoMarca, p.Nombre, p.Fabricante,
             p.CodigoSubLinea, p.Linea, p.NombreCategoriaPrincipal, p.NombreCategoria, p.Descuento,
             p.Encargado, p.Region, p.NombreTienda, p.Existencia_Total, p.Promocion, p.Status,
             p.Existencia_Total_CasaMatriz, p.Existencia_Total_Sucursales, u.Fecha
      from (select referencia || codigo_marca as Concatenar, referencia as Referencia,
              codigo_barra as CodigoBarra, nombre_marca as NombreMarca, codigo_marca as CodigoMarca,
              nombre as Nombre, fabricante as Fabricante, codigo_sublinea as CodigoSubLinea,
              nombre_sublinea as Linea, nombre_categoria_principal as NombreCategoriaPrincipal,
              nombre_categoria as NombreCategoria, {_discount('precio_detal', 'precio_promocion')} as Descuento,
              {_owner('nombre_sublinea')} as Encargado, {_region('store_id')} as Region,
              nombre_tienda as NombreTienda, existencia as Existencia_Total, promocion as Promocion,
              status as Status,
              sum(case when {_region('store_id')} like '%Casa Matriz' then existencia else 0 end)
                over (partition by referencia, codigo_marca) as Existencia_Total_CasaMatriz,
              sum(case when {_region('store_id')} like '%Sucursales' then existencia else 0 end)
                over (partition by referencia, codigo_marca) as Existencia_Total_Sucursales
            from por_tienda
            where (referencia, codigo_marca) in
              (select (referencia, codigo_marca) from por_tienda where existencia > 0)) p
      join ultimo u on p.Concatenar = u.Concatenar""",
    "limpia": _no_stock_cleared("foto"),
    "v1": _pivot_all("foto"),
    "v2": _branches("foto"),
    "v3": _house("foto"),
    "v4": _house("foto", positive=False),
})

EXCLUDED = "upper(CodigoMarca) not in ('BRAND#1', 'BRAND#12', 'BRAND#20')"
EXCLUDED_LINES = "upper(CodigoSubLinea) not in ('EC', 'ST')"
NOT_2001 = "coalesce(year(try_strptime(Fecha, '%d/%m/%Y')) <> 2001, true)"
TRIM = "Concatenar, CodigoMarca, Descuento, Promocion"


def _view_columns(labels, *totals: str) -> str:
    """Columns of a refined view."""
    return f"{FIXED}, {_names(labels)}, {', '.join(totals)}, Descuento_Catalogo, _dup_desc"


SELECTS = {
    "s1_load_snapshot_sources": " union all ".join(
        f"select '{t}' as tabla, '{c}' as columna, count(*) as filas, count(*) - count({c}) as nulos, "
        f"cast(coalesce(sum(('0x' || substr(md5({_canonical(c, kind)}), 1, 8))::bigint), 0) as bigint) as suma from {t}"
        for t, columns in BASE_COLUMNS.items() for c, kind in columns.items()),
    "s2_load_table": "select * from part",
    "s3_load_catalog_files": "select Concatenar, nullif(Descuento_Catalogo, '') as Descuento_Catalogo from catalogo",
    "s3_catalog_cells_over_lines": "select Concatenar, nullif(Descuento_Catalogo, '') as Descuento_Catalogo from catalogo",
    "s3_catalog_workbooks": "select Concatenar, nullif(Descuento_Catalogo, '') as Descuento_Catalogo from catalogo",
    "s4_catalog_contract": "select * from catalogo",
    "s5_export_view": "select * from v3",
    "s5_export_workbook": "select * from v3",
    "s6_export_columns": f"""
      select Concatenar, CodigoMarca, coalesce(cast("{STORE_LABELS[0]}" as varchar), '') as "{STORE_LABELS[0]}",
             cast(Sucursal_Total as varchar) as Sucursal_Total,
             cast(Casa_matriz_Total as varchar) as Casa_matriz_Total,
             coalesce(cast("{STORE_LABELS[-1]}" as varchar), '') as "{STORE_LABELS[-1]}" from v1""",
    "s7_discount_report": f"""
      select Concatenar, coalesce(Descuento, '') as Descuento, coalesce(Descuento_Catalogo, '') as Descuento_Catalogo
      from ({_with_catalog('v3')})""",
    "s8_snapshot_cache": f"""
      select carga, v.* from (select unnest(['first', 'again']) as carga) cross join (
        select 'branches' as vista, Concatenar, CodigoMarca, Descuento, Sucursal_Total as total from ({_branches('limpia')})
        union all select 'house', Concatenar, CodigoMarca, Descuento, Casa_matriz_Total from ({_house('limpia')})) v""",
    "s8_refresh_by_change": " union all ".join(
        f"select '{name}' as vista, Concatenar, CodigoMarca, Descuento, Promocion, {total} as total from ({pivot('limpia')})"
        for name, total, pivot in (("all", "Sucursal_Total", _pivot_all), ("branches", "Sucursal_Total", _branches),
                                   ("house", "Casa_matriz_Total", _house))),
    "s8_stored_by_item": f"""
      select {_view_columns(BRANCH_STORES, 'Sucursal_Total')}
      from ({_flagged(f"({_with_catalog('(' + _branches('limpia') + ')')})")})""",
    "v_all_views_one_pass": " union all ".join(
        f'select \'{n}\' as vista, {FIXED}, "{column}" as cantidad from {view}' for n, view, column in (
            ("all", "v1", STORE_LABELS[0]), ("all_last", "v1", "Sucursal_Total"), ("branches", "v2", "Sucursal_Total"),
            ("house", "v3", "Casa_matriz_Total"))),
    "p1_item_key": """
      select i.item_id, coalesce(i.referencia, '') || coalesce(i.codigo_marca, '') as Concatenar,
             coalesce(i.referencia, '') || coalesce(b.nombre, '') as con_nombre
      from dim_item i left join brand_lookup b on i.codigo_marca = b.codigo""",
    "p2_region_bucket": f"""
      select store_id, {_region('store_id')} as Region, count(*) as filas from fact_stock group by all""",
    "p3_discount_label": f"""
      select item_id, store_id, precio_detal, precio_promocion,
             {_discount('precio_detal', 'precio_promocion')} as Descuento,
             {_discount('(case when promocion = 0 then precio_detal end)', 'precio_promocion')} as sin_precio
      from fact_stock""",
    "p4_owner_assignment": f"""
      select i.item_id, c.nombre_sublinea, {_owner('c.nombre_sublinea')} as Encargado
      from dim_item i join dim_category c on i.category_id = c.category_id""",
    "p5_store_column_label": """
      select CodigoBarra, Promocion, Status, Region || ' - ' || NombreTienda as etiqueta from etiquetado""",
    "p6_share_of_row_total": f"""
      select *, {_share('Existencia_Total_CasaMatriz', '(Existencia_Total_CasaMatriz + Existencia_Total_Sucursales)')} as casa,
             {_share('Existencia_Total_Sucursales', '(Existencia_Total_CasaMatriz + Existencia_Total_Sucursales)')} as sucursales
      from (select distinct Referencia, CodigoMarca, Existencia_Total_CasaMatriz, Existencia_Total_Sucursales from foto)""",
    "p7_share_of_global_total": f"""
      select Referencia, Existencia_Total, {_global_share('Existencia_Total', 'total')} as parte,
             {_given_share('Existencia_Total', 'cast(1000000 as double)')} as parte_dada
      from (select Referencia, sum(Existencia_Total) as Existencia_Total,
                   sum(sum(Existencia_Total)) over () as total
            from etiquetado where Referencia is not null group by Referencia)""",
    "p8_promo_flag_normalise": """
      select item_id, store_id, status, case when status = 'F' then cast(promocion as varchar)
             else cast(promocion as varchar) || ' x' end as Promocion from fact_stock""",
    "p9_null_promo_without_stock": """
      select Concatenar, CodigoBarra, NombreTienda, Status, Existencia_Total, Promocion, Descuento from limpia""",
    "p10_catalog_percent_format": f"""
      select p_partkey, texto, {_pct('texto')} as porcentaje
      from (select p_partkey, case when p_size < 10 then p_brand
                   else cast(p_size / 4 as varchar) || ' %' end as texto from part)""",
    "f1_nonnegative_stock": "select * from fact_stock where existencia >= 0",
    "f2_view_scope": "select * from etiquetado where Region like '%Casa Matriz%'",
    "f3_region_equals": "select * from etiquetado where Region = 'R1 - Sucursales'",
    "f4_brand_equals": f"select {TRIM}, Casa_matriz_Total, Sucursal_Total from v1 where CodigoMarca = 'Brand#12'",
    "f5_reference_equals": f"""
      select {TRIM}, Referencia, Casa_matriz_Total, Sucursal_Total from v1
      where lower(trim(Referencia)) = 'red widget'""",
    "f6_exclude_brands": f"select {TRIM}, Casa_matriz_Total, Sucursal_Total from v1 where {EXCLUDED}",
    "f7_exclude_sublines": f"select {TRIM}, CodigoSubLinea, Casa_matriz_Total from v1 where {EXCLUDED_LINES}",
    "f8_promo_only": f"select {TRIM}, Casa_matriz_Total from v3 where Promocion = 1",
    "f9_exclude_year": f"""
      select Concatenar, CodigoBarra, NombreTienda, Promocion, Status, Fecha from foto where {NOT_2001}""",
    "f9_exclude_year_spellings": """
      select o_orderkey, Fecha from (
        select o_orderkey, cast(o_orderdate as date) as dia, case o_orderkey % 4
                 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%-d/%-m/%Y')
                 when 2 then strftime(o_orderdate, '%Y-%m-%d') else 'sin fecha' end as Fecha from orders)
      where Fecha = 'sin fecha' or year(dia) <> 1996""",
    "f10_main_house_stock_range": f"select {TRIM}, Casa_matriz_Total from v1 where Casa_matriz_Total between 1 and 11",
    "f11_value_search": """
      select distinct Referencia from foto where lower(Referencia) like '%ring%' order by Referencia""",
    "f11_gram_search": " union all ".join(
        f"select distinct '{t}' as texto, Referencia from foto where lower(Referencia) like '%{t.lower()}%'"
        for t in ("RING", "in", "G", "ring ")),
    "f12_catalog_match": f"""
      select {TRIM}, Descuento_Catalogo, Casa_matriz_Total from ({_with_catalog('v3')})
      where Descuento_Catalogo = Descuento""",
    "f12_catalog_mismatch": f"""
      select {TRIM}, Descuento_Catalogo, Casa_matriz_Total from ({_with_catalog('v3')})
      where Descuento_Catalogo <> Descuento or Descuento_Catalogo is null or Descuento is null""",
    "f13_duplicates_only": f"select {TRIM}, _dup_desc, Sucursal_Total from ({_flagged('v2')}) where _dup_desc",
    "f13_unique_only": f"select {TRIM}, _dup_desc, Sucursal_Total from ({_flagged('v2')}) where not _dup_desc",
    "f14_drop_empty_rows": """
      select *, Casa_matriz_Total > 0 as en_casa from (
        select Concatenar,
               sum(case when Region like '%Casa Matriz%' then Existencia_Total else 0 end) as Casa_matriz_Total,
               sum(case when Region like '%Sucursales%' then Existencia_Total else 0 end) as Sucursal_Total
        from etiquetado group by Concatenar)
      where not (Casa_matriz_Total = 0 and Sucursal_Total = 0)""",
    "f14_positive_total": """
      select Concatenar, sum(Existencia_Total) as Casa_matriz_Total from etiquetado
      where Region like '%Casa Matriz%' group by Concatenar having sum(Existencia_Total) > 0""",
    "f15_movement_filter": """
      select * from movement_line join movement_header using (numero)
      where status = 'F' and cantidad not in (1, -1)""",
    "j1_star_join": """
      select item_id, store_id, referencia, codigo_marca, codigo_barra, nombre_sublinea,
             nombre_categoria_principal, nombre_tienda, existencia, precio_detal, precio_promocion,
             promocion, status from unidos""",
    "j2_positive_items_semi": """
      select e.* from etiquetado e join (select distinct Referencia, CodigoMarca from etiquetado
        where Existencia_Total > 0) p on e.Referencia = p.Referencia and e.CodigoMarca = p.CodigoMarca""",
    "j3_movement_join": """
      select Concatenar, CodigoBarra, Referencia, CodigoMarca, Cantidad, NumeroTransferencia, Fecha,
             Nombre, Fabricante, CategoriaCodigo, CategoriaNombre, Marca, Linea from movimientos""",
    "j4_prefix_lookup": """
      select i.codigo_barra, i.codigo_categoria, l.nombre as Linea
      from op_item i left join line_lookup l on left(i.codigo_categoria, 4) = l.codigo""",
    "j5_brand_lookup": """
      select i.codigo_barra, i.codigo_marca, b.nombre as Marca
      from op_item i left join brand_lookup b on i.codigo_marca = b.codigo""",
    "j6_last_movement_join": "select e.*, u.Fecha from etiquetado e join ultimo u on e.Concatenar = u.Concatenar",
    "j7_attributes_with_pivot": f"""
      select a.*, t.total from (select distinct {FIXED} from foto) a
      left join (select Concatenar, sum(Existencia_Total) as total from foto group by Concatenar) t
        on a.Concatenar = t.Concatenar""",
    "j8_catalog_left_join": f"select {TRIM}, Descuento_Catalogo, Casa_matriz_Total from ({_with_catalog('v1')})",
    "a1_stock_by_item_store": "select * from por_tienda",
    "a1_stock_by_shared_item": "select * from por_tienda",
    "k19_collated_shared_item": """
      select * replace (upper(referencia) as referencia, upper(codigo_marca) as codigo_marca, upper(codigo_barra) as codigo_barra,
        upper(nombre_marca) as nombre_marca, upper(nombre) as nombre, upper(fabricante) as fabricante,
        upper(codigo_sublinea) as codigo_sublinea, upper(nombre_sublinea) as nombre_sublinea,
        upper(nombre_categoria_principal) as nombre_categoria_principal, upper(nombre_categoria) as nombre_categoria,
        upper(nombre_tienda) as nombre_tienda, upper(status) as status) from por_tienda""",
    "k19_collated_view": f"""
      select {_view_columns(HOUSE_REGIONS, 'Casa_matriz_Total')}
      from ({_flagged(f"({_with_catalog('(' + _house('limpia') + ')')})")})""",
    "a2_positive_keys": "select distinct Referencia, CodigoMarca from etiquetado where Existencia_Total > 0",
    "a3_stock_by_reference": """
      select Referencia, sum(Existencia_Total) as Existencia_Total from foto
      where Referencia is not null group by Referencia""",
    "a4_first_attributes": f"""
      select {FIXED} from (select {FIXED}, row_number() over (partition by Concatenar order by {FIXED}) as rn
        from foto) where rn = 1""",
    "a4_distinct_attributes": f"select distinct {FIXED} from foto where Region like '%Sucursales%'",
    "a5_distinct_values": "select distinct Referencia from foto where Referencia is not null",
    "a5_region_choices": """
      select 0 as orden, 'Todas' as Region
      union all select distinct 1, Region from etiquetado where Region like '%Sucursales%'""",
    "v1_pivot_all_stores": "select * from v1",
    "v1_pivot_many_columns": f"""
      select * from (
        select Concatenar, {_sums("(Region || ' - ' || NombreTienda || '/' || Status || '/' || Promocion)", WIDE_LABELS)},
               sum(case when Region like '%Casa Matriz%' then Existencia_Total else 0 end) as Casa_matriz_Total,
               sum(case when Region like '%Sucursales%' then Existencia_Total else 0 end) as Sucursal_Total
        from foto group by Concatenar)
      where not (Casa_matriz_Total = 0 and Sucursal_Total = 0)""",
    "v2_pivot_branches": "select * from v2",
    "v3_pivot_main_house": "select * from v3",
    "v4_pivot_main_house_share": f"""
      select *, {_global_share('Casa_matriz_Total', '(select sum(Casa_matriz_Total) from v4)')}
             as Porcentaje_Existencia_CasaMatriz from v4""",
    "n1_item_totals_by_scope": """
      select *, sum(case when Region like '%Casa Matriz' then Existencia_Total else 0 end)
                  over (partition by Referencia, CodigoMarca) as Existencia_Total_CasaMatriz,
             sum(case when Region like '%Sucursales' then Existencia_Total else 0 end)
                  over (partition by Referencia, CodigoMarca) as Existencia_Total_Sucursales
      from etiquetado""",
    "n2_last_movement": "select * from ultimo",
    "n3_duplicate_flag": f"select {TRIM}, Linea, Encargado, _dup_desc, Casa_matriz_Total from ({_flagged('v3')})",
    "o1_order_by_reference": "select * from etiquetado order by Referencia",
    "q1_stock_snapshot": "select * from foto order by Referencia",
    "q1_stock_snapshot_shared_item": """
      select Referencia, CodigoBarra, NombreTienda, Promocion, Status, Existencia_Total, Descuento,
             Existencia_Total_CasaMatriz, Existencia_Total_Sucursales, Fecha from foto""",
    "q2_stock_view": f"""
      , pv as ({_branches(f'(select * from limpia where {NOT_2001})')}),
      filtrada as (select * from pv where {EXCLUDED} and {EXCLUDED_LINES} and Promocion = 1),
      con as ({_with_catalog('filtrada')})
      select {_view_columns(BRANCH_STORES, 'Sucursal_Total')} from ({_flagged('con')})""",
    "q2_stock_view_all_stores": f"""
      , pv as ({_pivot_all(f'(select * from limpia where {NOT_2001})')}),
      filtrada as (select * from pv where {EXCLUDED} and Casa_matriz_Total between 1 and 500),
      con as (select * from ({_with_catalog('filtrada')}) where Descuento_Catalogo <> Descuento)
      select {_view_columns(STORE_LABELS, 'Sucursal_Total', 'Casa_matriz_Total',
                            'Porcentaje_Existencia_CasaMatriz', 'Porcentaje_Existencia_Sucursales')}
      from ({_flagged('con')}) where not _dup_desc""",
    "q2_stock_view_reference": f"""
      , pv as (select *, '' as Descuento_Catalogo from ({_house('limpia')}) where lower(trim(Referencia)) = 'red widget')
      select {_view_columns(HOUSE_REGIONS, 'Casa_matriz_Total')} from ({_flagged('pv')}) where _dup_desc""",
    "q3_discount_audit": f"""
      , pv as ({_house('limpia')})
      select Concatenar, coalesce(Descuento, '') as Descuento, coalesce(Descuento_Catalogo, '') as Descuento_Catalogo
      from ({_with_catalog('pv')}) where coalesce(Descuento_Catalogo <> Descuento, true)""",
}


def _needed(text: str) -> list[str]:
    """CTEs a text refers to, directly or through others, in order of definition."""
    seen: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in CTES:
            if name in words and name not in seen:
                seen.add(name)
                todo.append(CTES[name])
    return [name for name in CTES if name in seen]


def oracle_texts() -> dict[str, str]:
    texts = {}
    for name, select in SELECTS.items():
        ctes = ",\n".join(f"{c} as ({CTES[c].strip()})" for c in _needed(select))
        if name.endswith("_shared_item"):
            ctes = ctes.replace("dim_item as (", "own_item as (", 1).replace("dim_category as (", SHARED + "dim_category as (", 1)
        if name == "s8_refresh_by_change":
            ctes = ctes.replace("fact_stock as (", "own_stock as (", 1).replace("movement_line as (", CHANGED + "movement_line as (", 1)
        texts[name] = (f"with {ctes}\n" if ctes else "") + select.strip()
    return texts
