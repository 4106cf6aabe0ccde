"""Column names, view names and source layouts shared by every operator."""

from __future__ import annotations

# --- fixed values: names that callers and exported files rely on -------------

ITEM_KEY = "Concatenar"
STOCK = "Existencia_Total"
REGION = "Region"
STORE = "NombreTienda"
DISCOUNT = "Descuento"
CATALOG_DISCOUNT = "Descuento_Catalogo"
CATALOG_PERCENT = "% Descuento"
PROMO = "Promocion"
HOUSE_TOTAL = "Casa_matriz_Total"
BRANCH_TOTAL = "Sucursal_Total"
HOUSE_SHARE = "Porcentaje_Existencia_CasaMatriz"
BRANCH_SHARE = "Porcentaje_Existencia_Sucursales"
DUPLICATE_FLAG = "_dup_desc"

HOUSE_WORD = "Casa Matriz"
BRANCH_WORD = "Sucursales"

VIEW_ALL = "Todo"
VIEW_BRANCHES = "Solo Sucursales"
VIEW_HOUSE = "Solo Casa Matriz"
VIEWS = (VIEW_ALL, VIEW_BRANCHES, VIEW_HOUSE)
ALL_REGIONS = "Todas"

FIXED_ATTRIBUTES = (
    "Concatenar", "Referencia", "CodigoMarca", "NombreMarca", "Nombre",
    "Fabricante", "CodigoSubLinea", "Linea", "Encargado", "Descuento",
    "Promocion", "NombreCategoria", "Fecha",
)

SNAPSHOT_COLUMNS = (
    "Concatenar", "Referencia", "CodigoBarra", "NombreMarca", "CodigoMarca",
    "Nombre", "Fabricante", "CodigoSubLinea", "Linea",
    "NombreCategoriaPrincipal", "NombreCategoria", "Descuento", "Encargado",
    "Region", "NombreTienda", "Existencia_Total", "Promocion", "Status",
    "Existencia_Total_CasaMatriz", "Existencia_Total_Sucursales", "Fecha",
)

# Warehouse and operational tables: our table name -> (source table,
# {source column: our column}).  Columns a source lacks are simply not renamed.
WAREHOUSE_LAYOUT = {
    "dim_item": ("tbDimInventario", {
        "dimID_Inventario": "item_id", "dimID_Categoria": "category_id",
        "Referencia": "referencia", "CodigoMarca": "codigo_marca",
        "CodigoBarra": "codigo_barra", "NombreMarca": "nombre_marca",
        "Nombre": "nombre", "Fabricante": "fabricante",
        "NombreCategoria": "nombre_categoria"}),
    "fact_stock": ("tbHecInventario", {
        "dimid_inventario": "item_id", "dimid_tienda": "store_id",
        "Existencia": "existencia", "PrecioDetal": "precio_detal",
        "PrecioPromocion": "precio_promocion", "Promocion": "promocion",
        "Status": "status"}),
    "dim_store": ("tbDimTiendas", {
        "dimID_Tienda": "store_id", "Nombre": "nombre_tienda"}),
    "dim_category": ("tbDimCategorias", {
        "dimID_Categoria": "category_id", "CodigoSubLinea": "codigo_sublinea",
        "NombreSubLinea": "nombre_sublinea",
        "Nombre": "nombre_categoria_principal"}),
    "movement_line": ("MOVTRANSFERENCIAS", {
        "Numero": "numero", "CodigoBarra": "codigo_barra",
        "Cantidad": "cantidad"}),
    "movement_header": ("TRANSFERENCIAS", {
        "Numero": "numero", "Fecha": "fecha", "Status": "status",
        "CodigoRecibe": "codigo_recibe", "Correccion": "correccion",
        "Observacion": "observacion"}),
    "op_item": ("INVENTARIO", {
        "CodigoBarra": "codigo_barra", "Referencia": "referencia",
        "CodigoMarca": "codigo_marca", "Nombre": "nombre",
        "Categoria": "codigo_categoria", "Fabricante": "codigo_fabricante"}),
    "op_category": ("CATEGORIAS", {"Codigo": "codigo", "Nombre": "nombre"}),
    "brand_lookup": ("MARCAS", {"Codigo": "codigo", "Nombre": "nombre"}),
    "destination": ("SUCURSALES", {"Codigo": "codigo"}),
    "maker": ("FABRICANTES", {"Codigo": "codigo", "Nombre": "nombre"}),
}
