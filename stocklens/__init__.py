"""Retail stock analytics on Spark DataFrames."""

from .operators.filters import (
    by_brand, by_reference, by_region, catalog_match, clear_promo_without_stock, drop_empty_rows,
    dup_mode, exclude_brands, exclude_sublines, exclude_year, nonnegative_stock, promo_only, scope,
    stock_range, valid_movements, value_search,
)
from .operators.aggregates import (
    distinct_values, item_attributes, region_choices, stock_by_item_store, stock_by_reference, stock_cells,
)
from .operators.collation import collate_keys, collate_tables, plain_texts
from .operators.groups import duplicate_flag, last_movement, order_by_reference, with_scope_totals
from .operators.joins import (
    attributes_with_totals, brand_lookup, item_dimension, label_by_table, movements, positive_items, positive_keys,
    prefix_lookup, star_join, with_catalog, with_last_movement,
)
from .operators.pivots import (
    global_share, pivot_all_stores, pivot_branches, pivot_main_house, pivot_main_house_share,
    pivot_views, stock_and_attributes, store_columns,
)
from .plans.snapshot import last_movement_dates, stock_snapshot
from .plans.view import ViewFilters, discount_audit, stock_view
from .rules import DEFAULT_RULES, LabelRule, StockRules
from .session import build_session
from .sources.cache import Snapshot
from .sources.catalog import as_catalog, load_catalog
from .sources.contents import column_checksums
from .sources.layout import store_by_item
from .sources.search import GramIndex
from .sources.sinks import EmptyViewError, discount_report, export_columns, export_view, split_columns
from .sources.tables import load_sources, load_table, load_warehouse, strip_columns
from .sources.versions import KeptSnapshot, RangedTable
from .sources.workbooks import read_workbooks, write_workbooks
