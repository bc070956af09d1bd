"""Configuration: defaults, and a YAML or JSON file merged onto them."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from scorelake.sources.loaders import DatasetSpec


@dataclass
class Named:
    """A model or an evaluator: its name, type, and any further settings."""

    name: str
    type: str = ""
    settings: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str, default: Any = None) -> Any:
        return self.settings.get(key, default)


@dataclass
class Config:
    models: dict[str, Named] = field(default_factory=lambda: {"echo": Named("echo", "rule"), "http": Named("http", "http")})
    datasets: dict[str, DatasetSpec] = field(default_factory=lambda: {t: DatasetSpec(t, name=t) for t in ("capability", "dream-1k", "etbench-captioning", "video-hallucer", "event-hallusion", "perception-test", "test50-camera", "test50-dense", "tvbench", "tomato")})
    evaluators: dict[str, Named] = field(default_factory=lambda: {t: Named(t, t) for t in ("bleu", "rouge", "cider", "dsg", "video-hallucer", "event-hallusion", "event-hallusion-judged", "perception-test", "tomato", "tvbench", "etbench", "autodq", "etva", "test-50-ranking", "test50-dense-ranking", "pairwise")})
    logging: dict[str, Any] = field(default_factory=lambda: {"level": "INFO", "file": None})

    def merged(self, data: dict[str, Any]) -> Config:
        """A copy with data's settings: known names are changed setting by setting, others are added."""
        out = copy.deepcopy(self)
        for part in ("models", "evaluators"):
            for name, own in (data.get(part) or {}).items():
                item = getattr(out, part).setdefault(name, Named(name, (own or {}).get("type", name)))
                for key, value in (own or {}).items():
                    if key == "type":
                        item.type = value
                    else:
                        item.settings[key] = value
        for name, own in (data.get("datasets") or {}).items():
            item = out.datasets.setdefault(name, DatasetSpec((own or {}).get("type", name), name=name))
            for key, value in (own or {}).items():
                if key in DatasetSpec.__dataclass_fields__ and key != "extra":
                    setattr(item, key, value)
                else:
                    item.extra[key] = value
        out.logging |= data.get("logging") or {}
        return out

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls().merged(read_file(path))

    def model(self, name: str) -> Named:
        return _strict(self.models, name, "model")

    def dataset(self, name: str) -> DatasetSpec:
        return _strict(self.datasets, name, "dataset")

    def evaluator(self, name: str) -> Named:
        return _strict(self.evaluators, name, "evaluator")

    def as_dict(self) -> dict[str, Any]:
        named = lambda items: {n: {"type": x.type} | x.settings for n, x in items.items()}
        data = {n: {k: v for k, v in vars(x).items() if k not in ("name", "extra") and v} | x.extra for n, x in self.datasets.items()}
        return {"models": named(self.models), "datasets": data, "evaluators": named(self.evaluators), "logging": self.logging}

    def save(self, path: str | Path) -> None:
        path, data = Path(path), self.as_dict()
        if path.suffix in (".yaml", ".yml"):
            import yaml

            path.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True))
        else:
            path.write_text(json.dumps(data, indent=2, ensure_ascii=False))


def _strict(items: dict, name: str, kind: str):
    if name not in items:
        raise KeyError(f"no {kind} {name!r}; known: {', '.join(sorted(items))}")
    return items[name]


def read_file(path: str | Path) -> dict[str, Any]:
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(path.read_text()) or {}
    if path.suffix == ".json":
        return json.loads(path.read_text())
    raise ValueError(f"{path}: neither YAML nor JSON")


def scaffold(folder: str | Path) -> list[Path]:
    """A project: configuration, data and output folders, and a note."""
    root = Path(folder)
    for part in ("configs", "data", "output"):
        (root / part).mkdir(parents=True, exist_ok=True)
    Config().save(root / "configs/benchmark.yaml")
    (root / "README.md").write_text("# Evaluation project\n\nEdit configs/benchmark.yaml, put annotations and media under data, then: python -m scorelake run -m MODEL -d DATASET -e EVALUATOR\n")
    return sorted(root.rglob("*"))
