"""Parameter grids of the known searches, as plain values."""

from __future__ import annotations

# --- fixed values: search presets ------------------------------------------------------------------
LOGISTIC_SMOKE = [{"C": [0.1, 1.0], "l1_ratio": [0.0]}, {"C": [1.0], "l1_ratio": [1.0]}, {"C": [1.0], "l1_ratio": [0.5]}]
LOGISTIC_FULL = [
    {"C": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.0]},
    {"C": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [1.0]},
    {"C": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.2, 0.5, 0.8]},
]
FOREST_SMOKE = [{"n_estimators": [200], "max_depth": [10, None], "max_features": ["sqrt"], "min_samples_leaf": [1, 5]}]
FOREST_FRONTIER = [{"n_estimators": [200, 300], "max_depth": [10, 20], "max_features": ["sqrt"], "min_samples_leaf": [1, 5]}]
FOREST_FULL = [{"n_estimators": [100, 300, 500], "max_depth": [10, 20, None], "max_features": ["sqrt", 0.5, None], "min_samples_leaf": [1, 5, 10]}]
BOOSTING_SMOKE = [{"learning_rate": [0.05, 0.1], "max_leaf_nodes": [15, 31], "min_samples_leaf": [20], "l2_regularization": [0.0]}]
# ---------------------------------------------------------------------------------------------------


def stored_text(grid: dict[str, list]) -> dict[str, list[str]]:
    """A grid as run registries hold it: prefixed names, values as JSON text without quotes."""
    return {f"model__{name}": ["null" if v is None else str(v) for v in values] for name, values in grid.items()}
