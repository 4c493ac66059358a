"""Settings of a run as checked dataclasses, and the manifest that names its parts.

Everything here is plain Python on the driver; unknown keys are errors.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class DataStage:
    name: str
    start_training_step: int
    folders: list[str] = field(default_factory=list)
    weights: list[float] | None = None
    sequence_length: int = 2048
    seed: int = 42

    def __post_init__(self):
        if self.start_training_step < 1:
            raise ValueError("a stage starts at step 1 or later")
        if self.weights is not None and (len(self.weights) != len(self.folders) or any(w < 0 for w in self.weights) or not sum(self.weights) > 0):
            raise ValueError("one weight of at least 0 for each folder, not all 0")


@dataclass(frozen=True)
class Batching:
    micro_batch_size: int
    ranks: int
    accumulation: int = 1
    drop_last: bool = True

    def __post_init__(self):
        if min(self.micro_batch_size, self.ranks, self.accumulation) < 1:
            raise ValueError("sizes are at least 1")

    @property
    def global_batch_size(self) -> int:
        return self.micro_batch_size * self.ranks * self.accumulation

    def steps(self, samples: int, consumed: int = 0) -> int:
        """Batches left; nothing left is an error."""
        left = samples - consumed
        if left <= 0:
            raise ValueError(f"no samples left: {consumed} of {samples}")
        return left // self.global_batch_size if self.drop_last else -(-left // self.global_batch_size)


@dataclass(frozen=True)
class Run:
    stages: list[DataStage]
    batching: Batching
    train_steps: int

    def __post_init__(self):
        starts, names = [s.start_training_step for s in self.stages], [s.name for s in self.stages]
        if starts != sorted(set(starts)) or starts[:1] != [1] or len(set(names)) < len(names):
            raise ValueError("stages are sorted, start at 1, and have distinct steps and names")


def from_dict(kind: type, values: dict, overrides: dict[type, type] | None = None):
    """A dataclass from nested dictionaries; keys it doesn't have are errors. overrides:
    classes to take in place of others, which they must extend."""
    overrides = overrides or {}
    for base, own in overrides.items():
        if not issubclass(own, base):
            raise ValueError(f"{own.__name__} doesn't extend {base.__name__}")
    of = lambda base, v: from_dict(overrides.get(base, base), v, overrides)
    kind = overrides.get(kind, kind)
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"{kind.__name__}: unknown {sorted(extra)}")
    nested = {"stages": lambda v: [of(DataStage, x) for x in v], "batching": lambda v: of(Batching, v)}
    return kind(**{k: nested[k](v) if k in nested and issubclass(kind, Run) else v for k, v in values.items()})


def cache_key(**parameters) -> str:
    """A name for what a set of parameters gives, for tables kept between runs."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
