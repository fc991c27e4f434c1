"""Config-driven feature chains and multi-input step graphs.

Both only compose lazy DataFrames; jobs run where a step has to be fitted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featherloom.params import ParameterError
from featherloom.plans.steps import step_named
from featherloom.session import materialise


#: Keys of a fitted state that hold the path of a table.
STATE_TABLES = ("table", "rare_table")


class FeatureChain:
    """A list of steps fitted in order on one table and replayed on others."""

    def __init__(self, steps: list[dict], states: list | None = None):
        self.steps = [{"name": s["name"], "parameters": dict(s.get("parameters", {}))} for s in steps]
        for s in self.steps:
            step = step_named(s["name"])
            if len(step.inputs) != 1 or step.any_inputs:
                raise ParameterError(f"{s['name']} takes several tables; use a StepGraph")
            step.check(s["parameters"])
        self.states = states

    def fit_transform(self, df: DataFrame, spill: bool = False) -> DataFrame:
        """``spill`` writes the table before each fitted step, so costly earlier steps run once only."""
        states = []
        for s in self.steps:
            step = step_named(s["name"])
            if spill and step.fit:
                df = materialise(df, "chain")
            state = step.fit_state([df], s["parameters"])
            states.append(state)
            df = step.run([df], s["parameters"], state)
        self.states = states
        return df

    def fit(self, df: DataFrame, spill: bool = False) -> FeatureChain:
        self.fit_transform(df, spill)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.states is None:
            raise ParameterError("the chain is not fitted")
        for s, state in zip(self.steps, self.states):
            df = step_named(s["name"]).run([df], s["parameters"], state)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder that holds all the chain needs: steps and fitted states as one JSON document, state tables beside it."""
        if self.states is None:
            raise ParameterError("the chain is not fitted")

        def copied(table: str) -> str:
            name = f"table-{uuid.uuid4().hex}"
            spark.read.parquet(table).write.parquet(f"{path}/{name}")
            return name

        text = json.dumps({"steps": self.steps, "states": _with_tables(self.states, copied)}, default=float)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/steps")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureChain:
        saved = json.loads(spark.read.text(f"{path}/steps").first()[0])
        return cls(saved["steps"], _with_tables(saved["states"], lambda name: f"{path}/{name}"))


def _with_tables(state, place: Callable[[str], str]):
    """The states with every path of a state table replaced."""
    if isinstance(state, dict):
        return {k: place(v) if k in STATE_TABLES and isinstance(v, str) else _with_tables(v, place) for k, v in state.items()}
    return [_with_tables(v, place) for v in state] if isinstance(state, (list, tuple)) else state


class StepGraph:
    """Named steps whose inputs are other steps' outputs (``<step>__output``) or free inputs.

    ``steps`` = [{"name", "transformation": {"name", "parameters"}, "inputs": {input: source}}], in an
    order in which every source comes first.
    """

    def __init__(self, steps: list[dict]):
        self.steps = []
        self.states: dict[str, object] = {}
        made: set[str] = set()
        self.free: list[str] = []
        for s in steps:
            t = s["transformation"]
            step = step_named(t["name"])
            parameters = dict(t.get("parameters", {}))
            step.check(parameters)
            wanted = dict(s.get("inputs") or {})
            names = list(wanted) if step.any_inputs else list(step.inputs)
            extra = [k for k in wanted if k not in names]
            if extra:
                raise ParameterError(f"step {s['name']} has no inputs {extra}")
            sources = []
            for n in names:
                source = wanted.get(n, f"{s['name']}__{n}")
                if source.endswith("__output") and source not in made:
                    raise ParameterError(f"step {s['name']} reads {source}, which no earlier step makes")
                if source not in made and source not in self.free:
                    self.free.append(source)
                sources.append(source)
            self.steps.append((s["name"], step, parameters, sources))
            made.add(f"{s['name']}__output")

    def _walk(self, frames: dict[str, DataFrame], fit: bool, first_steps: int | None, spill: bool) -> DataFrame:
        missing = [n for _, _, _, sources in self.steps[:first_steps] for n in sources if n in self.free and n not in frames]
        if missing:
            raise ParameterError(f"missing inputs {sorted(set(missing))}")
        ready, out = dict(frames), None
        for name, step, parameters, sources in self.steps[:first_steps]:
            inputs = [ready[s] for s in sources]
            if fit:
                self.states[name] = step.fit_state(inputs, parameters)
            out = step.run(inputs, parameters, self.states.get(name))
            if spill:
                out = materialise(out, name)
            ready[f"{name}__output"] = out
        if out is None:
            raise ParameterError("no step to run")
        return out

    def fit_transform(self, first_steps: int | None = None, spill: bool = False, **frames: DataFrame) -> DataFrame:
        """``first_steps`` runs a prefix; ``spill`` writes every step's result to the shared folder."""
        return self._walk(frames, True, first_steps, spill)

    def transform(self, first_steps: int | None = None, spill: bool = False, **frames: DataFrame) -> DataFrame:
        return self._walk(frames, False, first_steps, spill)
