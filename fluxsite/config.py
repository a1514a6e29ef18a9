"""Parameters of the analysis.

Every domain literal lives here, as a default of a frozen dataclass, so a
different estate can pass its own vocabulary without touching the plans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the reference's values for equal results.
# ---------------------------------------------------------------------------
# Resources in the order of the consumption workbook sheets (sheet 1..5).
SHEET_ORDER = ("elec", "eau", "gaz", "reseau", "fod")
# Resources in the column order of the three reports.
REPORT_ORDER = ("elec", "gaz", "eau", "fod", "reseau")
# Unit prices (EUR per kWh, per m3, per litre) -- defaults of the analysis.
DEFAULT_PRICES = {"elec": 0.09, "gaz": 0.07, "fod": 0.32, "eau": 3.5, "reseau": 0.07}
# Cost coefficient applied after the price.
COEFFICIENTS = {"elec": 1.5, "gaz": 1.5, "eau": 1.0, "fod": 1.5, "reseau": 1.5}
# Display unit of each resource.
UNIT_LABELS = {"elec": "kWh", "gaz": "kWh", "eau": "m3", "fod": "kWh", "reseau": ""}
# Output column names of the allocated consumption and its cost per resource.
VALUE_COLUMNS = {
    "elec": "conso_elec_m2_kWh",
    "gaz": "conso_gaz_m2_kWh",
    "eau": "conso_eau_m2",
    "fod": "conso_fod_m2_kWh",
    "reseau": "conso_reseau_m2",
}
COST_COLUMNS = {"elec": "cout_elec", "gaz": "cout_gaz", "eau": "cout_eau", "fod": "cout_fod", "reseau": "cout_reseau"}
# Resources whose per-unit report drops incomplete rows (all but reseau).
OMIT_INCOMPLETE = ("elec", "gaz", "eau", "fod")
# Resources summed per building (NULL-skipping) before any join.
PRE_AGGREGATE = ("elec",)
# Buildings removed from one resource after the joins.
EXCLUDED_BUILDINGS = {"elec": ("irag",), "eau": ("sage",)}
# Occupying units that are not research units.
EXCLUDED_UNITS = ("IA", "IA COM", "INRAE")
# Aliases of the (unreturned) surface-by-unit summary.
SURFACE_SUMMARY_ALIASES = {"SDAR MUTUALISÉ": "SDAR", "LEPSE/IPSIM": "LEPSE/IPSiM"}
# Site kept in the occupancy.
SITE_PATTERN = "Gaillarde"
# Spelling aliases applied after upper-casing a unit name.
UNIT_ALIASES = {"SDAR MUTUALISÉ": "SDAR"}
# Staff unit whose building code is forced.
STAFF_RECODE_UNIT = "Associé BAP"
STAFF_RECODE_BUILDING = "0070"
# Soft-delete column and the value that keeps a row.
SOFT_DELETE_COLUMN = "A SUPPRIMER"
SOFT_DELETE_KEEP = "NON"
# Tokens read as missing in every sheet.
NA_TOKENS = ("ND", "NA")
# Head count from the free-text occupant list.
HEADCOUNT_SEPARATORS = ",|/| et | - |\\+|;"
HEADCOUNT_ZERO_PATTERNS = ("Locaux", "véhicules|\\?|COMMUN", "Salle|salle")
HEADCOUNT_FIXED_PATTERN = "4 personnes"
HEADCOUNT_FIXED_VALUE = 4.0
# Share of the global cost attributed to the research units.
GLOBAL_SHARE = 0.6
# Building code inside a meter label: 1-based start, length.
METER_CODE_START, METER_CODE_LENGTH = 5, 4
# Building code inside a staff building label: 1-based start, length.
STAFF_CODE_START, STAFF_CODE_LENGTH = 2, 4
# Building codes of the fuel-oil sheet, by row position.
FOD_POSITIONAL_CODES = ("0290", "0310", "0030")
# Year pattern of the sheet headers.
YEAR_PATTERN = "20[0-9]{2}"
# Column names of the building-state sheet, by position.
STATE_COLUMNS = (
    "Site", "num_bat", "nom_bat", "Clos/couvert", "securite",
    "fonctionnement", "etat_energie", "confort d'usage adéquat aux besoins",
)
# Column names of the room survey sheet, by position (two trailing columns dropped).
ROOM_COLUMNS = (
    "Site", "num_bat", "Local", "Nom_usuel_local", "Libell_fichiersource/DIE",
    "Referencefichiersource/DIE", "Surface_sol", "Unite",
    "Nom_Tiers_accueillis", "Nom_occupants",
    "Nombre_unites", "Surface_ajus", "Typologie UMR",
)
ROOM_DROPPED_POSITIONS = (14, 15)
# Staff sheet: positions dropped, and the name of its first column.
STAFF_DROPPED_POSITIONS = (9, 10)
STAFF_FIRST_COLUMN = "Unite"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rates:
    """Unit prices of the five resources (keyword arguments of the analysis)."""

    elec: float = DEFAULT_PRICES["elec"]
    gaz: float = DEFAULT_PRICES["gaz"]
    fod: float = DEFAULT_PRICES["fod"]
    eau: float = DEFAULT_PRICES["eau"]
    reseau: float = DEFAULT_PRICES["reseau"]

    def price(self, resource: str) -> float:
        return float(getattr(self, known_resource(resource)))

    @classmethod
    def of(cls, prices: dict) -> "Rates":
        """Rates from a {resource: price} mapping; an unknown resource fails by name."""
        return cls(**{known_resource(r): float(p) for r, p in prices.items()})


def known_resource(resource: str) -> str:
    if resource not in SHEET_ORDER:
        raise ValueError(f"unknown resource {resource!r}; known: {', '.join(SHEET_ORDER)}")
    return resource


@dataclass(frozen=True)
class AnalysisConfig:
    """Vocabulary and rules of one estate; defaults reproduce the reference."""

    rates: Rates = field(default_factory=Rates)
    resources: tuple[str, ...] = REPORT_ORDER
    coefficients: dict = field(default_factory=lambda: dict(COEFFICIENTS))
    value_columns: dict = field(default_factory=lambda: dict(VALUE_COLUMNS))
    cost_columns: dict = field(default_factory=lambda: dict(COST_COLUMNS))
    unit_labels: dict = field(default_factory=lambda: dict(UNIT_LABELS))
    omit_incomplete: tuple[str, ...] = OMIT_INCOMPLETE
    pre_aggregate: tuple[str, ...] = PRE_AGGREGATE
    excluded_buildings: dict = field(default_factory=lambda: dict(EXCLUDED_BUILDINGS))
    excluded_units: tuple[str, ...] = EXCLUDED_UNITS
    site_pattern: str = SITE_PATTERN
    unit_aliases: dict = field(default_factory=lambda: dict(UNIT_ALIASES))
    surface_summary_aliases: dict = field(default_factory=lambda: dict(SURFACE_SUMMARY_ALIASES))
    na_tokens: tuple[str, ...] = NA_TOKENS
    positional_codes: dict = field(default_factory=lambda: {"fod": FOD_POSITIONAL_CODES})
    staff_recode_unit: str = STAFF_RECODE_UNIT
    staff_recode_building: str = STAFF_RECODE_BUILDING
    soft_delete_column: str = SOFT_DELETE_COLUMN
    soft_delete_keep: str = SOFT_DELETE_KEEP
    global_share: float = GLOBAL_SHARE
    # Resources whose building code comes from a (resource, ordinal) map.
    positional_code_resources: tuple[str, ...] = ("fod",)
    # Canonicalise unit names before grouping the rooms. False reproduces the
    # reference, which groups on the raw spelling and so can emit two rows
    # for one (building, unit); True merges them.
    canonicalise_first: bool = False

    def __post_init__(self):
        for r in self.resources:
            known_resource(r)

    def price(self, resource: str) -> float:
        return self.rates.price(resource)

    def coef(self, resource: str) -> float:
        return float(self.coefficients[resource])
