"""Finding columns by name on the driver; no job runs here."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from .text import normalise_name

# --- fixed values: spellings accepted for well-known columns -----------------
STOCK_NAMES = (
    "existenciatotal", "existencia", "stocktotal", "stock",
    "cantidadtotal", "cantidad", "inventariototal", "inventario",
)
STOCK_WORDS = ("existencia", "stock", "cantidad", "inventario")
SUBLINE_NAMES = ("codigosublinea", "codsublinea", "sublinea", "codigo_sublinea")
YEAR_NAMES = ("año", "anio", "year")
DATE_NAMES = ("fechadoc", "date", "fecharegistro")
HOUSE_TOTAL_NAMES = ("casamatriztotal", "totalcasamatriz")


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Fail at analysis time when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def stock_column(names: Sequence[str]) -> str | None:
    """Column holding the stock: exact spellings in priority order, then by word."""
    by_norm = {}
    for n in names:
        by_norm.setdefault(normalise_name(n), n)
    exact = next((by_norm[w] for w in STOCK_NAMES if w in by_norm), None)
    if exact is not None:
        return exact
    return next((n for n in names if any(w in normalise_name(n) for w in STOCK_WORDS)), None)


def house_total_column(names: Sequence[str]) -> str | None:
    """Main-house total of a pivot view, if the view has one."""
    def is_total(norm: str) -> bool:
        return norm in HOUSE_TOTAL_NAMES or (
            norm.startswith("casamatriz") and any(w in norm for w in ("total", *STOCK_WORDS)))

    return next((n for n in names if is_total(normalise_name(n))), None)


def subline_column(names: Sequence[str]) -> str | None:
    return next((n for n in names if n.strip().lower() in SUBLINE_NAMES), None)


def year_column(names: Sequence[str]) -> str | None:
    lowered = {}
    for n in names:
        lowered[n.strip().lower()] = n
    return next((lowered[y] for y in YEAR_NAMES if y in lowered), None)


def date_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names
            if "fecha" in n.strip().lower() or n.strip().lower() in DATE_NAMES]
