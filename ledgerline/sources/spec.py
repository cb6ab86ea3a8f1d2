"""Experiment specifications."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

try:
    import yaml
except ImportError:  # files are optional; specs can be built in code
    yaml = None


@dataclass
class Experiment:
    """What to model: the table, its feature columns, the target, and the run settings."""

    delivery: int
    filepath: str
    num_features: list[str]
    cat_features: list[str]
    target: str
    seed: int = 42
    output_dir: str = "results"
    device: str = "auto"
    filters: list[str] = field(default_factory=list)  # accepted and kept, not applied


def from_dict(d: dict) -> Experiment:
    data, run = d["data"], d.get("experiment", {})
    return Experiment(data["entrega"], data["filepath"], list(data["num_features"] or []), list(data["cat_features"] or []),
                      data["target"], filters=list(d.get("filtros") or []), **run)


def to_dict(e: Experiment) -> dict:
    flat = asdict(e)
    out = {
        "data": {"entrega": flat["delivery"], **{k: flat[k] for k in ("filepath", "num_features", "cat_features", "target")}},
        "experiment": {k: flat[k] for k in ("seed", "output_dir", "device")}}
    return {**out, "filtros": flat["filters"]} if flat["filters"] else out


def load_spec(path: str) -> Experiment:
    with open(path, encoding="utf-8") as f:
        return from_dict(_yaml().safe_load(f))


def save_spec(e: Experiment, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        _yaml().safe_dump(to_dict(e), f, allow_unicode=True, sort_keys=False)


def _yaml():
    if yaml is None:
        raise RuntimeError("reading and writing spec files needs PyYAML")
    return yaml
