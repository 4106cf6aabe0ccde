"""Label rules: ordered (label, values) lists that turn a code into a label.

Rules are caller data; ``DEFAULT_RULES`` carries the values in use for the
retail chain whose warehouse layout is in ``names.WAREHOUSE_LAYOUT``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class LabelRule:
    """Give ``label`` to every code in ``values``."""

    label: str
    values: tuple

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))


@dataclass(frozen=True)
class StockRules:
    """Region labels by store id and owner labels by sub-line name."""

    regions: Sequence[LabelRule]
    owners: Sequence[LabelRule]
    no_region: str = "Sin region"
    no_owner: str = "Sin encargado"

    def region_of(self, store_id) -> str:
        """Region of one store, for resolving pivot columns on the driver."""
        for rule in self.regions:
            if str(store_id) in map(str, rule.values):
                return rule.label
        return self.no_region


# --- fixed values: store ids per region and sub-lines per owner --------------
DEFAULT_RULES = StockRules(
    regions=(
        LabelRule("Valencia Casa Matriz", (2003,)),
        LabelRule("Oriente - Casa Matriz", (2005,)),
        LabelRule("Occidente - Casa Matriz", (2004,)),
        LabelRule("Margarita - Casa Matriz", (2006,)),
        LabelRule("Oriente - Sucursales", (
            1, 1002, 1004, 1006, 1009, 1010, 1011, 1012, 1013, 1014, 1017, 1018,
            1019, 1020, 1021, 1022, 1023, 1024)),
        LabelRule("Occidente - Sucursales", (
            1026, 1027, 1028, 1029, 1030, 1031, 1037, 1038, 1039, 1040, 1041,
            1042, 1043, 1044, 1045, 1046, 1047, 1048, 1050, 1052, 1053, 1055,
            2007)),
        LabelRule("Margarita - Sucursales", (1032, 1033, 1034, 1035, 1036)),
    ),
    owners=(
        LabelRule("Raul", (
            "PANTYS", "BRASSIER", "BOXER / INTERIOR", "PIJAMA", "PIJAMAS",
            "ROPA EXTERIOR", "ROPA DEPORTIVA", "ROPA DE PLAYA", "LENCERIA",
            "FAJAS", "CALCETERÍA", "ARTICULOS DE SERVICIO", "ACCESORIOS")),
        LabelRule("Jesenia", (
            "COSM TICOS", "BISUTERIA - JOYERIA", "HIGIENE - CUIDADO PERSONAL",
            "MAQUILLAJE", "BISUTERIA- CABELLO", "U AS", "BOLSAS DE REGALO")),
        LabelRule("Dairo", (
            "CALZADOS", "BOLSOS", "HOGAR", "TEXTILES HOGAR",
            "GORRAS / PASAMONTA AS0", "LENTES", "ESCOLAR", "PAPELERIA ESCOLAR",
            "BALONES")),
    ),
)
