"""Session settings that the engine relies on, and configuration from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Where tables live and which defaults hold; ``from_env`` reads TIDEMARK_* variables."""

    home: str = "tidemark-home"
    top_k: int = 5
    token_budget: int = 600
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ if env is None else env)
        return cls(home=env.get("TIDEMARK_HOME", cls.home), top_k=int(env.get("TIDEMARK_TOP_K", cls.top_k)), token_budget=int(env.get("TIDEMARK_TOKEN_BUDGET", cls.token_budget)))


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def open_session(app: str = "tidemark", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | options).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
