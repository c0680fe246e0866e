"""Closed run configurations: file, then environment, and no unknown key."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any, get_args, get_type_hints


@dataclass(frozen=True)
class PackConfig:
    """A tokenise-and-pack run."""

    shard_size: int = 100_000_000
    max_shards: int | None = None
    skip_tokens: int = 0
    end_id: int = 2
    out: str = ""


@dataclass(frozen=True)
class TrainingConfig:
    """What sizes a training run's data."""

    batch: int = 16
    accum: int = 32
    seq_len: int = 2048
    total_steps: int = 23_000
    warmup: int = 2_000
    peak: float = 0.02
    max_epochs: int = 4


def problems(kind: type, values: Mapping[str, Any], ignored: Iterable[str] = ()) -> list[str]:
    """What keeps values from being an instance of kind, in words."""
    rules = get_type_hints(kind)
    given = {k: v for k, v in values.items() if k not in set(ignored)}
    out = [f"unknown keys: {', '.join(sorted(given.keys() - rules.keys()))}"] if given.keys() - rules.keys() else []
    return out + [f"{k}: {v!r} is no {rules[k]}" for k, v in given.items() if k in rules and not _fits(v, rules[k])]


def _fits(value: Any, rule: Any) -> bool:
    kinds = get_args(rule) or (rule,)
    whole = isinstance(value, int) and not isinstance(value, bool)
    return whole and float in kinds or isinstance(value, kinds) and (whole or not isinstance(value, int) or bool in kinds)


def parsed(kind: type, values: Mapping[str, Any], ignored: Iterable[str] = ()):
    """An instance of kind, whose annotations are its schema; all that is wrong is one error."""
    if found := problems(kind, values, ignored):
        raise ValueError("; ".join(found))
    return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})


def from_file(kind: type, path: str, ignored: Iterable[str] = ()):
    import yaml

    with open(path, encoding="utf-8") as f:
        return parsed(kind, yaml.safe_load(f) or {}, ignored)


def overridden(config, names: Mapping[str, str], environment: Mapping[str, str] | None = None):
    """config with the fields whose environment variable (field: variable) is set and not empty."""
    environment = os.environ if environment is None else environment
    found = {field: environment[name] for field, name in names.items() if environment.get(name)}
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(config)}
    return replace(config, **{k: kinds[k](v) if kinds[k] in (int, float) else v for k, v in found.items()})


def eval_command(model: str, tasks: list[str], out: str, batch: int = 16, shots: int = 0) -> list[str]:
    """Arguments of an evaluation harness's command line."""
    # The names of its options.
    return ["lm_eval", "--model", "hf", "--model_args", f"pretrained={model}", "--tasks", ",".join(tasks), "--num_fewshot", str(shots), "--batch_size", str(batch), "--output_path", out]
