"""Contract constants. Fixed values that results must agree with."""

# Calendar window lengths, rel-day bins, lead bins, phases.
WINDOW_LENGTHS = (1, 3, 5, 7, 14)
REL_DAY_BINS = ((0, 2), (3, 7), (8, 14), (15, 31))
LEAD_BINS = ((1, 1), (2, 2), (3, 3), (4, 7), (8, 14), (15, 31), (32, None))
LANDMARKS = {
    "DOA0": ("doa", 0),
    "DOA2": ("doa", 2),
    "POD0": ("pod", 0),
    "POD1": ("pod", 1),
    "POD3": ("pod", 3),
    "POD7": ("pod", 7),
}

# Resampling, inference and selection thresholds.
BOOTSTRAP_DRAWS = 2000
MIN_VALID_DRAWS = 1990
TRAJECTORY_DRAWS, TRAJECTORY_VALID = 1000, 950
REPORT_DRAWS, LOCKED_DRAWS = 400, 1000  # of the daily and landmark reports, and of the fixed-threshold report
QUERY_DRAWS = BOOTSTRAP_DRAWS  # of the registered queries; scripts/verify.py --draws lowers it to compare them with DuckDB
MIN_EFFECT = 0.01
SELECTION_TIE_TOLERANCE = 0.002
IDENTITY_TOLERANCE = 1e-9
ADDITIVITY_TOLERANCE = 1e-4
CHANGE_TOLERANCE = 1e-6
ENGINEERED_COLUMN_CAP = 800

# Shrinkage strengths.
CODE_STRENGTH = 100.0
SITE_STRENGTH = 200.0

# Tokens read as missing.
MISSING_TOKENS = ("", ".", "NA", "NaN", "nan", "None")

EPOCH = "1899-12-30"


def valid_floor(draws: int) -> int:
    """Smallest number of valid draws for an interval: 1,990 of 2,000, in proportion."""
    return -(-draws * MIN_VALID_DRAWS // BOOTSTRAP_DRAWS)


def bin_label(low: int, high: int | None, prefix: str = "") -> str:
    if high is None:
        return f"{prefix}>{low - 1}"
    return f"{prefix}{low}" if low == high else f"{prefix}{low}-{high}"
