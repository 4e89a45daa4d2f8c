"""Parameters of the mapper."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Metric(enum.Enum):
    CONTAINMENT = "Containment"
    JACCARD = "Jaccard"
    BUCKET_SH = "bucket_SH"
    BUCKET_LCS = "bucket_LCS"


@dataclass(frozen=True)
class Params:
    """k-mer length, sampling ratio, similarity threshold, runner-up margin and overlap, hit cap, metric; files and output.

    max_seeds is kept for the record. no_bucket_pruning, one_sweep and abs_pos name variants of the mapper of which only
    the plain one exists, so they can't be set.
    """

    k: int = 15
    ratio: float = 0.05
    theta: float = 0.9
    min_diff: float = 0.02
    max_overlap: float = 0.5
    max_matches: int | None = None
    metric: Metric = Metric.CONTAINMENT
    reads_file: str = ""
    ref_file: str = ""
    params_file: str = ""
    max_seeds: int = -1
    sam: bool = False
    normalize: bool = False
    verbose: int = 0
    no_bucket_pruning: bool = False
    one_sweep: bool = False
    abs_pos: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "metric", Metric(self.metric))
        rules = {"k": 0 < self.k, "ratio": 0 < self.ratio <= 1, "theta": 0 <= self.theta <= 1, "min_diff": self.min_diff >= 0, "max_overlap": 0 <= self.max_overlap <= 1, "max_matches": self.max_matches is None or self.max_matches > 0, "verbose": 0 <= self.verbose <= 2}
        rules |= {name: not getattr(self, name) for name in ("no_bucket_pruning", "one_sweep", "abs_pos")}
        for name, fine in rules.items():
            if not fine:
                raise ValueError(f"{name} is out of range: {getattr(self, name)}")

    @property
    def theta2(self) -> float:
        """The least score that can matter for a runner-up."""
        return self.theta - self.min_diff

    def values(self) -> dict[str, str]:
        """Name and value of each parameter, as written into a table of runs."""
        flag = lambda x: str(int(x))
        return {
            "pFile": self.reads_file, "tFile": self.ref_file, "k": str(self.k), "hFrac": f"{self.ratio:.6f}", "max_seeds": str(self.max_seeds), "max_matches": str(self.max_matches or -1),
            "tThres": f"{self.theta:.6f}", "min_diff": f"{self.min_diff:.6f}", "max_overlap": f"{self.max_overlap:.6f}", "paramsFile": self.params_file, "metric": self.metric.value,
            "sam": flag(self.sam), "normalize": flag(self.normalize), "verbose": str(self.verbose), "no-bucket-pruning": flag(self.no_bucket_pruning), "one-sweep": flag(self.one_sweep), "abs-pos": flag(self.abs_pos),
        }

    def row(self, spark: SparkSession) -> DataFrame:
        """The parameters as a one-row DataFrame."""
        values = self.values()
        return spark.createDataFrame([tuple(values.values())], [*values])

    def write(self, spark: SparkSession, path: str) -> None:
        """One tab-separated row under a header."""
        self.row(spark).coalesce(1).write.csv(path, sep="\t", header=True)

    def listing(self) -> str:
        """All parameters, one a line, right-aligned names."""
        return "\n".join(["Parameters:", *(f"{name:>20}: {value}" for name, value in self.values().items())])

    def display(self) -> str:
        """The parameters that matter for a run's result, for a log."""
        v = self.values()
        shown = {"reference": "tFile", "reads": "pFile", "metric": "metric", "k": "k", "hFrac": "hFrac", "verbose": "verbose", "tThres": "tThres", "min_diff": "min_diff", "max_overlap": "max_overlap", "no-bucket-pruning": "no-bucket-pruning", "abs-pos": "abs-pos"}
        return "\n".join(["Params:", *(f" | {label + ':':<22} {v[name]}" for label, name in shown.items())])


#: The settings of the queries over the driver's tables.
DRIVER = Params(k=25, ratio=0.25, theta=0.4, min_diff=0.075, max_overlap=0.3)
