"""Analyzers: named kernels with a tier, what they need and give, and who may use them; selected by a policy and run in one pass.

An analyzer is a row of a registry, not a process: `select` picks kernels when the plan is made, and `run` hands them to the one
mapInPandas pass of operators/pixels.py, which isolates their errors and leaves out values that aren't finite.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pixels as P
from .pipeline import TIERS


@dataclass(frozen=True)
class Analyzer:
    name: str
    tier: str
    kernel: Callable[[np.ndarray], dict[str, float]]
    requires: tuple[str, ...] = ("original_image",)
    provides: tuple[str, ...] = ()
    licence: str = "permissive"
    confidence: float = 1.0


class Registry:
    """Analyzers by name; a name is registered once."""

    def __init__(self, analyzers: list[Analyzer] | None = None):
        self.known: dict[str, Analyzer] = {}
        for a in analyzers or []:
            self.register(a)

    def register(self, a: Analyzer) -> None:
        if a.name in self.known:
            raise ValueError(f"analyzer {a.name} is registered already")
        if a.tier not in TIERS:
            raise ValueError(f"no tier {a.tier}")
        self.known[a.name] = a

    def rows(self, spark: SparkSession) -> DataFrame:
        """The inventory: name, tier, requires, provides, licence."""
        return spark.createDataFrame([(a.name, a.tier, list(a.requires), list(a.provides), a.licence) for a in self.known.values()], "name string, tier string, requires array<string>, provides array<string>, licence string")


def default_registry() -> Registry:
    return Registry([Analyzer(k, "L0", f) for k, f in P.KERNELS.items()])


@dataclass(frozen=True)
class Config:
    """Which analyzers a pipeline runs. tiers: up to the last one; names: only these, if given."""

    tiers: tuple[str, ...] = tuple(TIERS)
    names: tuple[str, ...] = ()
    licences: tuple[str, ...] = ("permissive",)
    have: tuple[str, ...] = ("original_image",)
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, values: dict) -> Config:
        """Unknown keys are ignored; lists become tuples."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    def fingerprint(self) -> str:
        import hashlib
        import json

        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


#: Presets: all tiers, the first only, up to structure.
PRESETS = {"full": Config(), "proximal": Config(tiers=("L0",)), "structural": Config(tiers=("L0", "L1", "L2"))}


def select(registry: Registry, config: Config) -> list[Analyzer]:
    """The analyzers that a config takes, by tier, then as registered: their licence is allowed and what they need is there or given by an earlier one."""
    have, out = set(config.have), []
    for a in sorted(registry.known.values(), key=lambda a: TIERS.index(a.tier)):
        if a.tier in config.tiers and (not config.names or a.name in config.names) and a.licence in config.licences and set(a.requires) <= have:
            have |= set(a.provides)
            out.append(a)
    return out


def run(images: DataFrame, analyzers: list[Analyzer]) -> DataFrame:
    """Rows (id, key, value, error, analyzer, tier, confidence): every analyzer's values for every image, in one pass over them."""
    rows = P.extract(images, kernels={a.name: a.kernel for a in analyzers})
    name = F.substring_index("key", ".", 1)
    look = lambda kind, get: F.try_element_at(F.create_map(*(F.lit(x) for a in analyzers for x in (a.name, get(a)))), name).cast(kind)
    return rows.withColumns({"analyzer": name, "tier": look("string", lambda a: a.tier), "confidence": look("double", lambda a: a.confidence)}) if analyzers else rows.withColumns({"analyzer": name, "tier": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})


def inventory(registry: Registry, spark: SparkSession) -> DataFrame:
    """Analyzers of each tier, for a health page."""
    return registry.rows(spark).groupBy("tier").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
