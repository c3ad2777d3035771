"""Fixed values of the domain.

Everything in the block below is a FIXED VALUE that must equal the
reference behaviour for results to match (names of feed columns, source
mapping, emission factors, thresholds, region centroids, export labels).
They are stated plainly, in natural order, and not derived.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (domain constants)
# ---------------------------------------------------------------------------

# Raw feed artefact columns removed at Silver.
DROP_COLUMNS = ["column_68", "column_30"]

# Raw MW columns that arrive as string or number and are cast to double.
MW_CAST_COLUMNS = [
    "pompage", "stockage_batterie", "destockage_batterie",
    "eolien", "solaire", "hydraulique", "nucleaire", "gaz",
    "charbon", "fioul", "bioenergies",
]

# Raw feed name -> Silver name.
RENAME_MAP = {
    "consommation": "consommation_mw",
    "nucleaire": "nucleaire_mw",
    "eolien": "eolien_mw",
    "solaire": "solaire_mw",
    "hydraulique": "hydraulique_mw",
    "gaz": "gaz_mw",
    "charbon": "charbon_mw",
    "bioenergies": "bioenergies_mw",
    "fioul": "fioul_mw",
    "pompage": "pompage_mw",
    "stockage_batterie": "stockage_batterie_mw",
    "destockage_batterie": "destockage_batterie_mw",
}

# Silver MW column -> Gold source name (the 8 production sources).
SOURCE_COLUMN_MAP = {
    "nucleaire_mw": "nucleaire",
    "eolien_mw": "eolien",
    "solaire_mw": "solaire",
    "hydraulique_mw": "hydraulique",
    "gaz_mw": "gaz",
    "charbon_mw": "charbon",
    "fioul_mw": "fioul",
    "bioenergies_mw": "bioenergies",
}

# Thermal output of the regional feed (D19): raw column, Silver column, source name.
THERMAL_RAW, THERMAL_MW, THERMAL_SOURCE = "thermique", "thermique_mw", "thermique"

# Default source dimension: (source_name, is_green).
DEFAULT_SOURCES = [
    ("nucleaire", False),
    ("eolien", True),
    ("solaire", True),
    ("hydraulique", True),
    ("gaz", False),
    ("charbon", False),
    ("fioul", False),
    ("bioenergies", True),
]
SOURCES = [s for s, _ in DEFAULT_SOURCES]

# Capacity register filiere label (lower-cased, trimmed) -> source name.
FILIERE_MAP = {
    "hydraulique": "hydraulique",
    "hydraulique - fil de l'eau et éclusée": "hydraulique",
    "hydraulique - lacs": "hydraulique",
    "hydraulique - step turbinage": "hydraulique",
    "éolien terrestre": "eolien",
    "eolien terrestre": "eolien",
    "éolien en mer": "eolien",
    "eolien en mer": "eolien",
    "éolien": "eolien",
    "eolien": "eolien",
    "photovoltaïque": "solaire",
    "solaire": "solaire",
    "nucléaire": "nucleaire",
    "nucleaire": "nucleaire",
    "thermique gaz": "gaz",
    "gaz": "gaz",
    "thermique charbon": "charbon",
    "charbon": "charbon",
    "thermique fioul": "fioul",
    "fioul": "fioul",
    "bioénergies": "bioenergies",
    "bioenergies": "bioenergies",
    "bioénergie": "bioenergies",
}

# Unicode white space, as text cells are stripped of it.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Accent folding applied to capacity-register column names.
NAME_ACCENT_FOLD = {"é": "e", "è": "e", "ê": "e", "â": "a", "î": "i"}

# Column-name candidates in capacity registers, first present wins.
REGION_CODE_CANDIDATES = ["coderegion", "code_insee_region", "code_region", "code_insee", "codeinsee"]
REGION_NAME_CANDIDATES = ["region", "nom_region", "libelle_region", "nomreg"]
FILIERE_CANDIDATES = ["filiere", "filière", "source_energie"]
PUISSANCE_CANDIDATES = [
    "puismaxinstallee", "puissance_installee", "puiss_installee", "puissance_installee_mw",
    "puiss_mw", "puissance_mw", "puissance",
]
ANNEE_CANDIDATES = ["annee", "année", "year", "an"]

# Emission factors, gCO2eq per kWh (= kg per MWh).
EMISSION_FACTORS = {
    "nucleaire": 12,
    "eolien": 11,
    "hydraulique": 24,
    "solaire": 48,
    "bioenergies": 230,
    "gaz": 490,
    "fioul": 733,
    "charbon": 820,
}

# Carbon intensity bands: upper bound (exclusive) -> label; gauge cap.
CARBON_BANDS = [(100, "very_low"), (250, "low"), (400, "medium")]
CARBON_BAND_TOP = "high"
CARBON_GAUGE_MAX = 600

# Supply/demand balance tolerances: region map and national run detection.
REGION_BALANCE_TOLERANCE = 0.15
NATIONAL_BALANCE_TOLERANCE = 0.05

# Region centroids: code_insee -> (name, lat, lon).
REGION_CENTROIDS = {
    "11": ("Île-de-France", 48.85, 2.35),
    "24": ("Centre-Val de Loire", 47.75, 1.67),
    "27": ("Bourgogne-Franche-Comté", 47.28, 5.99),
    "28": ("Normandie", 49.18, 0.37),
    "32": ("Hauts-de-France", 50.48, 2.79),
    "44": ("Grand Est", 48.68, 6.18),
    "52": ("Pays de la Loire", 47.76, -0.33),
    "53": ("Bretagne", 48.20, -2.93),
    "75": ("Nouvelle-Aquitaine", 44.85, 0.74),
    "76": ("Occitanie", 43.89, 2.40),
    "84": ("Auvergne-Rhône-Alpes", 45.75, 4.84),
    "93": ("Provence-Alpes-Côte d'Azur", 43.94, 6.06),
    "94": ("Corse", 42.03, 9.01),
}

# Metropolitan France bounding box, inclusive.
FRANCE_LAT_MIN = 41.3
FRANCE_LAT_MAX = 51.1
FRANCE_LON_MIN = -5.2
FRANCE_LON_MAX = 9.6

# Null-handling rule sets: column -> strategy.
RTE_QUALITY_RULES = {
    "consommation_mw": "flag",
    "nucleaire_mw": "flag",
    "eolien_mw": "flag",
    "solaire_mw": "flag",
    "hydraulique_mw": "flag",
    "gaz_mw": "flag",
    "charbon_mw": "flag",
    "bioenergies_mw": "flag",
    "fioul_mw": "flag",
    "pompage_mw": "flag",
    "date_heure": "drop",
    "code_insee_region": "drop",
}
CAPACITY_QUALITY_RULES = {
    "code_insee_region": "drop",
    "puissance_installee_mw": "fill_zero",
}
ERA5_QUALITY_RULES = {
    "wind_speed_100m": "fill_zero",
    "temperature_c": "forward_fill",
    "ssrd": "fill_zero",
}

# Asset lifecycle thresholds (hours).
DEFAULT_STALENESS_HOURS = 24
DEFAULT_INACTIVE_HOURS = 168

# Quality gate tolerances.
ROW_COUNT_TOLERANCE_PCT = 5.0
LOAD_FACTOR_MAX = 1.5

# Page and limit defaults / maxima of the serving queries.
PRODUCTION_DEFAULT_LIMIT = 100
METEO_DEFAULT_LIMIT = 500
METEO_MAX_LIMIT = 5000
MAINTENANCE_DEFAULT_LIMIT = 100
MAINTENANCE_MAX_LIMIT = 500
CARBON_SERIES_POINTS = 96
TOP_SOURCES_N = 7

# Date presets of the dashboard (days).
PERIOD_PRESETS = {"24h": 1, "7d": 7, "30d": 30}

# French export: separator, decimal mark, header labels.
CSV_DELIMITER = ";"
CSV_DECIMAL_SEP = ","
EXPORT_COLUMN_LABELS = {
    "code_insee": "Code INSEE",
    "nom_region": "Région",
    "horodatage": "Horodatage",
    "source_name": "Source",
    "valeur_mw": "Valeur (MW)",
    "facteur_charge": "Facteur de charge",
}

# Default gate configuration.
DEFAULT_GATES = [
    {"name": "silver_rte_null_check", "layer": "silver", "table": "rte_production",
     "check": "null_check", "columns": ["code_insee_region", "date_heure"], "severity": "CRITICAL"},
    {"name": "silver_rte_mw_range", "layer": "silver", "table": "rte_production",
     "check": "range_check", "column": "consommation_mw", "min": 0, "max": 100000, "severity": "WARNING"},
    {"name": "silver_rte_freshness", "layer": "silver", "table": "rte_production",
     "check": "freshness", "time_column": "date_heure", "max_age_hours": 24, "severity": "WARNING"},
    {"name": "gold_fk_integrity", "layer": "gold", "table": "FACT_ENERGY_FLOW",
     "check": "fk_exists", "fk_columns": {"id_region": "DIM_REGION", "id_date": "DIM_TIME",
                                          "id_source": "DIM_SOURCE"}, "severity": "CRITICAL"},
    {"name": "gold_facteur_charge_range", "layer": "gold", "table": "FACT_ENERGY_FLOW",
     "check": "facteur_charge_range", "severity": "WARNING"},
]

# Outage page: cell classes of one ``tr.event-row``.
EVENT_ROW_CLASS = "event-row"
EVENT_CELL_CLASSES = {
    "event-id": "event_id",
    "unit-name": "unit_name",
    "area": "affected_area",
    "event-type": "event_type",
    "start-date": "start_date",
    "end-date": "end_date",
    "unavail-mw": "unavailable_mw",
    "description": "description",
}

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------
