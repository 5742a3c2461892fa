"""Fixed market values and the run settings built on them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the market: product attributes, limits and rules.
PRODUCTS = ["DALMP", "RTLMP", "RegUp", "RegDown", "RRS", "NSRS"]

PRODUCT_ATTRIBUTES = [
    # product, display name, unit, category, can be negative, sort order
    ("DALMP", "Day-Ahead LMP", "$/MWh", "energy", True, 1),
    ("RTLMP", "Real-Time LMP", "$/MWh", "energy", True, 2),
    ("RegUp", "Regulation Up", "$/MW", "ancillary", False, 3),
    ("RegDown", "Regulation Down", "$/MW", "ancillary", False, 4),
    ("RRS", "Responsive Reserve", "$/MW", "ancillary", False, 5),
    ("NSRS", "Non-Spinning Reserve", "$/MW", "ancillary", False, 6),
]
DEFAULT_UNIT = "$/MWh"

PLAUSIBLE_LIMITS = {
    # product: (lowest, highest, outlier threshold in standard deviations)
    "DALMP": (-500.0, 2000.0, 10.0),
    "RTLMP": (-500.0, 2000.0, 10.0),
    "RegUp": (0.0, 1000.0, 5.0),
    "RegDown": (0.0, 1000.0, 5.0),
    "RRS": (0.0, 500.0, 5.0),
    "NSRS": (0.0, 500.0, 5.0),
}

ANCILLARY = ["RegUp", "RegDown", "RRS", "NSRS"]
ORDER_RULES = [(energy, other, "greater_than") for energy in ("DALMP", "RTLMP") for other in ANCILLARY]

SPREAD_PAIRS = [
    ("DALMP", "RTLMP"),
    ("DALMP", "RegUp"),
    ("DALMP", "RegDown"),
    ("DALMP", "RRS"),
    ("DALMP", "NSRS"),
    ("RegUp", "RegDown"),
]

STD_FACTORS = {"DALMP": 1.0, "RTLMP": 1.2, "RegUp": 0.8, "RegDown": 0.8, "RRS": 0.7, "NSRS": 0.7}
FIXED_STD = {"DALMP": 5.0, "RTLMP": 8.0, "RegUp": 3.0, "RegDown": 3.0, "RRS": 2.5, "NSRS": 2.0}
DEFAULT_FIXED_STD = 5.0

HOUR_CATEGORIES = {
    # category: closed hour ranges
    "peak_hours": [(7, 22)],
    "off_peak_hours": [(0, 6), (23, 23)],
    "solar_hours": [(8, 17)],
    "evening_ramp": [(16, 20)],
}
BASE_FEATURES = ["load_mw", "hour", "day_of_week", "month", "is_weekend"]
PRODUCT_FEATURES = {
    "DALMP": ["day_ahead_demand_forecast", "wind_forecast", "solar_forecast", "thermal_availability"],
    "RTLMP": ["real_time_demand", "wind_generation", "solar_generation", "thermal_generation"],
    "RegUp": ["regulation_requirement", "available_regulation_capacity", "thermal_ramp_rate"],
    "RegDown": ["regulation_requirement", "available_regulation_capacity", "thermal_ramp_rate"],
    "RRS": ["responsive_reserve_requirement", "available_responsive_capacity"],
    "NSRS": ["non_spinning_reserve_requirement", "available_non_spinning_capacity"],
}
HOUR_FEATURES = {
    "peak_hours": ["peak_load_ratio", "peak_price_ratio"],
    "off_peak_hours": ["off_peak_load_ratio", "off_peak_price_ratio"],
    "solar_hours": ["solar_generation", "solar_forecast", "cloud_cover"],
    "evening_ramp": ["ramp_rate", "load_change_rate"],
}
INTERACTION_PAIRS = [
    ("load_mw", "hour"),
    ("load_mw", "is_weekend"),
    ("renewable_ratio", "hour"),
    ("price_volatility", "hour"),
]

LAGS = [1, 2, 3, 6, 12, 24, 48, 72, 168]
VOLATILITY_ROWS = [24, 48, 168]
CONFIDENCE_LEVELS = [0.5, 0.8, 0.9, 0.95, 0.99]
PINBALL_LEVELS = [0.1, 0.5, 0.9]
DISPLAY_PERCENTILES = (10, 90)
HISTOGRAM_BINS = 30
HORIZON_HOURS = 72
SAMPLE_COUNT = 100
MARKET_ZONE = "America/Chicago"
RATIO_FLOOR = 0.9
SMOOTHNESS_LIMIT = 0.3
COVERAGE_LIMIT = 0.9
FALLBACK_DAYS = 7
FALLBACK_MIN_HOURS = 24
RETENTION_DAYS = 90
STORAGE_VERSION = "1.0.0"
SCHEMA_VERSION = "1.0.0"


@dataclass(frozen=True)
class RunSettings:
    """What a daily run needs to know besides its input tables."""

    products: list[str] = field(default_factory=lambda: list(PRODUCTS))
    fuels: list[str] = field(default_factory=lambda: ["wind", "solar", "gas", "coal", "nuclear"])
    horizon_hours: int = HORIZON_HOURS
    sample_count: int = SAMPLE_COUNT
    seed: int = 1
    method: str = "residuals"
    methods: dict[str, str] = field(default_factory=dict)
    distribution: str = "normal"
    distributions: dict[str, str] = field(default_factory=dict)
    history_days: int = 7
    fallback_days: int = FALLBACK_DAYS
