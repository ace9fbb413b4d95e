"""What a panel looks like and how its columns are treated."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key columns of a panel (many dated rows per entity).

    ``row`` is a unique row id. It only decides which of several rows of one
    entity and date comes first; panels with one row per date need none.
    """

    entity: str = "customer_ID"
    time: str = "S_2"
    row: str | None = None

    @property
    def keys(self) -> list[str]:
        return [c for c in (self.entity, self.time, self.row) if c]


# Column lists and fill constants of the statement panel.
SPARSE_COLUMNS = (
    "B_39", "B_42", "D_42", "D_66", "D_73", "D_76", "D_87", "D_88", "D_108", "D_110", "D_111",
    "D_134", "D_135", "D_136", "D_137", "D_138",
)
FILL_VALUES = {
    "D_64": "-1",
    "D_117": -1, "D_126": -1,
    "D_68": 0, "D_144": 0, "D_120": 0, "B_30": 0,
    "D_114": 1, "D_116": 1,
    "B_38": 2,
}
ONE_HOT_COLUMNS = ("D_63", "D_64")
MODE_COLUMNS = ("B_30", "B_38", "D_114", "D_116", "D_117", "D_120", "D_126", "D_68")
SPARSE_AFTER_AGGREGATION = (
    "R26", "D_138", "D_66", "D_88", "D_137", "R_9", "D_111", "D_73", "D_142", "D_132", "D_134",
    "D_49", "D_136", "D_42", "B_29", "D_110", "D_87", "D_135", "D_106", "D_108", "D_56", "B_17",
    "D_53", "D_50", "D_105", "D_82",
)
LOGISTIC_C = 0.36257120538682047
LOGISTIC_MAX_ITER = 900
SPLIT_SEED = 44
SAMPLE_SEED = 0
SEARCH_TRIALS = 54
SEARCH_PARALLELISM = 4
FOLDS = 5


@dataclass(frozen=True)
class CleaningRules:
    """Which columns are dropped, filled, one-hot encoded and condensed to a mode."""

    drop: tuple[str, ...] = SPARSE_COLUMNS
    fill: dict = field(default_factory=lambda: dict(FILL_VALUES))
    one_hot: tuple[str, ...] = ONE_HOT_COLUMNS
    modes: tuple[str, ...] = MODE_COLUMNS
    drop_aggregated: tuple[str, ...] = SPARSE_AFTER_AGGREGATION
