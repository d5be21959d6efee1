"""Fixed values of the domain: standards, bands, physical constants and model settings."""

from __future__ import annotations

import math

# Health standards and the hazard scale (ug/m3).
NAAQS_24H = 80.0
NAAQS_ANNUAL = 40.0
WHO_24H = 25.0
HAZARDOUS = 180.0

# Hazard bands [min, max) with label, key, colour and advice.
HAZARD_BANDS = (
    {"code": 1, "category": "Normal", "key": "normal", "color": "#2e7d32", "min": 0.0, "max": 40.0,
     "advice": "Air quality is satisfactory."},
    {"code": 2, "category": "Moderate", "key": "moderate", "color": "#f9a825", "min": 40.0, "max": 80.0,
     "advice": "Acceptable; sensitive individuals take caution."},
    {"code": 3, "category": "Unhealthy", "key": "unhealthy", "color": "#ef6c00", "min": 80.0, "max": 180.0,
     "advice": "Prolonged exposure causes respiratory discomfort."},
    {"code": 4, "category": "Hazardous", "key": "hazardous", "color": "#c62828", "min": 180.0, "max": math.inf,
     "advice": "Trigger industrial/traffic reduction alerts."},
)

# Units and geometry.  The kilometres per degree differ by operator on purpose.
NO2_MOLAR_MASS_G = 46.0055
COLUMN_SCALE = 1e6
UMOL_TO_G_M2 = NO2_MOLAR_MASS_G * 1e-6
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6_371.0
STATION_KM_LAT, STATION_KM_LON = 110.57, 111.32
GRID_M_LAT, GRID_M_LON = 110_574.0, 111_320.0
AMBIENT_M_PER_DEG = 111_000.0
DAY_SECONDS = 86_400.0
TAU_DAYTIME_HOURS = 5.0
GHSL_CELL_M2 = 10_000.0
YEAR_DAYS = 365.25

# Screening.
STATION_HOURS = (12, 16)
MIN_COMPLETENESS = 0.75
QA_THRESHOLD = 0.75
MAX_CLOUD_FRACTION = 0.3
MIN_VALID_SUBPIXEL = 0.5
MIN_DAY_COVERAGE = 0.20
MOSAIC_WINDOWS = (7, 15, 31)
EXCLUDED_PERIODS = (("2020-03-22", "2020-05-31"),)
COMBUSTION_FUELS = ("Coal", "Gas", "Oil", "Biomass", "Waste", "Petcoke", "Cogeneration")
MASKED_SCENE_CLASSES = (3, 8, 9, 10, 11)
SPIKE_BASELINE_DAYS = 7
UPWIND_KM = 5.0
UPWIND_WATER_SHARE = 0.3

# City aliases.
CITY_ALIASES = {
    "bombay": "mumbai", "bangalore": "bengaluru", "gurgaon": "gurugram", "calcutta": "kolkata",
    "madras": "chennai", "poona": "pune", "trivandrum": "thiruvananthapuram", "new delhi": "delhi",
    "navimumbai": "navi mumbai", "mysore": "mysuru", "baroda": "vadodara", "benares": "varanasi",
}

# Road class weights; other classes weigh 0.7.
ROAD_WEIGHTS = {"motorway": 3.0, "trunk": 2.5, "primary": 2.0, "secondary": 1.5, "tertiary": 1.0}
ROAD_WEIGHT_OTHER = 0.7
