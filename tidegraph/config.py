"""Names and bounds of the analysis; every operator takes them as parameters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Relation ids in their fixed order.
RELATIONS = ("mention", "retweet", "reply", "quote")
#: Per relation these four, then the tweet count: the 17 structural features in order.
PER_RELATION = ("out_degree", "in_degree", "out_strength_log1p", "in_strength_log1p")
FEATURES = (*(f"{r}_{f}" for r in RELATIONS for f in PER_RELATION), "tweet_count_log1p")


@dataclass(frozen=True)
class Config:
    """Sizes and limits of one analysis."""

    start_quarter: str = "2017-Q4"
    end_quarter: str = "2026-Q2"
    earliest: str = "2006-03-21"
    latest: str = "2026-06-30"
    max_lengths: tuple[int, ...] = (128, 256, 512, 1024, 2048)
    quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 0.999)
    short_chars: int = 64
    medium_chars: int = 256
    dimension: int = 64
    seed: int = 7
    sample_limit: int = 100
    node_buckets: int = 16
    weight_tolerance: float = 1e-6
    relations: tuple[str, ...] = field(default=RELATIONS)

    @property
    def first_index(self) -> int:
        return quarter_index(self.start_quarter)

    @property
    def snapshots(self) -> int:
        return quarter_index(self.end_quarter) - self.first_index + 1

    def fingerprint(self) -> str:
        """Hash of all settings, for reports and resume guards."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def quarter_index(label: str) -> int:
    """Quarters since year 0 of a label like '2017-Q4'."""
    year, _, quarter = label.partition("-Q")
    if len(year) != 4 or not year.isdigit() or quarter not in ("1", "2", "3", "4"):
        raise ValueError(f"no quarter: {label!r}")
    return int(year) * 4 + int(quarter) - 1


def load_config(path: str | Path) -> Config:
    """Settings from a JSON or YAML file; unknown names are an error."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yml", ".yaml")):
        import yaml

        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)
    unknown = set(given) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    made = Config(**given)
    if made.snapshots < 1:
        raise ValueError("the calendar ends before it starts")
    return made


DEFAULT = Config()
