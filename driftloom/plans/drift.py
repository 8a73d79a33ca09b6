"""Drift detection, localization and characterization by transition matrices, as one configured plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.process_tree import from_dfg
from ..operators import changes, detection, localization
from ..operators.features import CONTROL_FLOW, check_features, full_matrix
from ..operators.transitions import transition_log
from ..operators.windows import WindowSpec, window_table


@dataclass
class DriftPlan:
    """Each ``run_*`` returns a DataFrame and keeps it; stages that an asked-for one needs run first.

    features: names of control flow features; pairs: (method, attribute) of the time, resource and data perspectives.
    strategies: {"delta_matrix_strategy": {...}, "statistic_test_strategy": {...}} as in ``changes``."""

    events: DataFrame
    spec: WindowSpec = field(default_factory=lambda: WindowSpec(100, 50))
    mode: str = "Fixed"
    features: tuple[str, ...] = ("frequency", "probability")
    time_features: tuple[tuple[str, str], ...] = ()
    resource_features: tuple[tuple[str, str], ...] = ()
    data_features: tuple[tuple[str, str], ...] = ()
    threshold_anomaly: float = 0
    strategies: dict = field(default_factory=dict)

    def __post_init__(self):
        self._pairs = (*self.time_features, *self.resource_features, *self.data_features)
        check_features(self.features, self._pairs)
        own = [a for m, a in (*self.resource_features, *self.data_features)]
        self.attributes = tuple(dict.fromkeys(own))
        self._log = self._n = self._tm = self._change = None

    @property
    def log(self) -> DataFrame:
        if self._log is None:
            self._log = transition_log(self.events, self.attributes).cache()
        return self._log

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.log.count()
        return self._n

    def windows(self) -> DataFrame:
        return window_table(self.events.sparkSession, self.n, self.spec)

    def run_process_representation(self) -> DataFrame:
        """The matrices of all windows."""
        if self._tm is None:
            numeric = tuple(dict.fromkeys(a for m, a in self._pairs if m.startswith("numerical")))
            cats = tuple(dict.fromkeys(a for m, a in self._pairs if m in ("categorical_unique", "categorical_entropy")))
            alpha = bool(set(self.features) & {"causality", "parallel", "choice", "loop"})
            self._tm = full_matrix(self.log, self.spec, self.n, threshold=self.threshold_anomaly, numeric=numeric, time=bool(self.time_features), categorical_attrs=cats, alpha=alpha)
        return self._tm

    def run_change_representation(self) -> DataFrame:
        if self._change is None:
            self._change = changes.change_representation(self.run_process_representation(), self.windows(), self.strategies, self.mode).cache()
        return self._change

    def run_detection(self, tasks: dict[str, dict]) -> DataFrame:
        """{change feature: {"strategy": "time_series" | "threshold", ...}}: detection_strategy, feature and
        detection_results of each."""
        change, out = self.run_change_representation(), None
        for feature, task in tasks.items():
            options = {k: v for k, v in task.items() if k != "strategy"}
            signal = detection.unpivot(change, feature)
            if task["strategy"] == "time_series":
                found = detection.time_series(signal, self.mode, size=self.spec.size, step=self.spec.stride, overlap=self.spec.overlap, **options)
            elif task["strategy"] == "threshold":
                found = detection.threshold(signal, **options)
            else:
                raise ValueError(f"unknown strategy {task['strategy']!r}")
            found = found.select("detection_strategy", "feature", "detection_results")
            out = found if out is None else out.union(found)
        return out

    def localize(self, reference: int, detected: int, **options) -> dict[str, DataFrame]:
        """significant_changes, dfg_ref, dfg_det, dfg_changes and high_level_changes of two windows."""
        tm = self.run_process_representation()
        ref, det = (tm.filter(f"window_index = {int(w)}").drop("window_index") for w in (reference, detected))
        names = tuple(c for c in tm.columns if c not in ("window_index", "activity_from", "activity_to"))
        resource, data = (tuple(a for _, a in x) for x in (self.resource_features, self.data_features))
        found = localization.significant_changes(ref, det, names, resource=resource, data=data, **options)
        a, b = localization.build_dfg(ref), localization.build_dfg(det)
        diff = localization.compare_dfgs(a, b)
        return {"significant_changes": found, "dfg_ref": a, "dfg_det": b, "dfg_changes": diff, "high_level_changes": localization.high_level_changes(found, diff)}

    def characterize(self, reference: int, detected: int, instructions: dict | str, ask: Callable[[str], str] = lambda prompt: prompt) -> str:
        """The answer of ``ask`` to a prompt of the instructions (a YAML file's path or its contents) with the sections
        that its ``sources`` name. Matrices in a prompt hold control flow only."""
        conf = load_instructions(instructions) if isinstance(instructions, str) else instructions
        where = self.localize(reference, detected)
        tm = self.run_process_representation()
        flow = [c for c in CONTROL_FLOW if c in tm.columns]
        sections = {
            "reference_matrix": lambda: _table(tm.filter(f"window_index = {int(reference)}").select("activity_from", "activity_to", *flow)),
            "detection_matrix": lambda: _table(tm.filter(f"window_index = {int(detected)}").select("activity_from", "activity_to", *flow)),
            "significant_changes": lambda: _table(where["significant_changes"].select("transition.*", "feature", "transition_status", "p_value", "effect_size", "ref_value", "det_value")),
            "high_level_changes": lambda: "\n".join(f"{k}: {v}" for k, v in localization.as_map(where["high_level_changes"]).items()),
            "reference_tree": lambda: from_dfg(where["dfg_ref"].collect()),
            "detection_tree": lambda: from_dfg(where["dfg_det"].collect()),
        }
        parts = [conf["main_instructions"]]
        for name in conf["sources"]:
            if name not in sections and name not in conf:
                raise ValueError(f"instructions name an unknown source: {name}")
            parts.append(f"## {name}\n{sections[name]() if name in sections else conf[name]}")
        return ask("\n\n".join(parts))


def _table(df: DataFrame) -> str:
    return df.orderBy("activity_from", "activity_to").toPandas().to_string(index=False)


def load_instructions(path: str) -> dict:
    import yaml

    with open(path) as f:
        conf = yaml.safe_load(f)
    if missing := {"sources", "main_instructions"} - set(conf):
        raise ValueError(f"instructions lack {', '.join(sorted(missing))}")
    return conf
