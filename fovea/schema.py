"""Canonical columns, keys and numeric tolerances."""

FOV_KEYS = ["patient_id", "timepoint", "fov_id"]
REL_PATIENT = ["relation_id", "patient_id"]
ENTRY_KEYS = ["relation_id", "patient_id", "entry_type", "row_id", "col_id"]
COORD = ["entry_type", "row_id", "col_id"]

# Canonical column names of a cell table.
CELL_COLUMNS = [
    "cell_id", "patient_id", "timepoint", "fov_id",
    "domain_label", "cell_subtype_label", "x", "y",
]

# Numeric tolerances.
MASS_TOL = 1e-12
ZERO_BAND = 1e-12
SIMPLEX_TOL = 1e-8
SYMMETRY_TOL = 1e-12

# Beyond this many states, compositions are counted in long form; the results are the same.
WIDE_STATE_LIMIT = 64
