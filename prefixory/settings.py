"""Settings of the engine, each overridable by an environment variable of the same name in capitals."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    suggest_limit: int = 10
    trie_node_capacity: int = 25
    cache_nodes: int = 4
    cache_vnodes: int = 150
    cache_ttl_seconds: float = 30.0
    cache_capacity_per_node: int = 5000
    batch_max_size: int = 500
    batch_flush_interval: float = 2.0
    new_query_initial_count: int = 1
    wal_enabled: bool = True
    default_ranking_mode: str = "basic"
    recency_half_life: float = 1800.0
    recency_weight: float = 0.6
    history_weight: float = 0.4
    trending_capacity: int = 50_000
    latency_window: int = 20_000

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Values of the environment; what does not parse keeps its default."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw, default = env.get(f.name.upper()), f.default
            if raw is None:
                continue
            if isinstance(default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, str):
                found[f.name] = raw
            elif re.fullmatch(r"\s*[+-]?\d+\s*", raw) or isinstance(default, float) and re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", raw):
                found[f.name] = type(default)(raw)
        return cls(**found)


#: Modes a suggestion can be ranked in.
MODES = ("basic", "trending")
#: Recency rows at most that join a pool, and the score they must exceed.
TRENDING_POOL, MIN_RECENCY = 50, 1e-3
