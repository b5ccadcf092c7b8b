"""Parameters of an assembly."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

#: Settings of a session that name parameters: ``spark.helixplan.k`` and so on.
PREFIX = "spark.helixplan."


@dataclass(frozen=True)
class AssemblyParams:
    """``k`` is the k-mer length and ``min_count`` the least support of a solid k-mer.

    A walk between mates is good if its start-to-start distance plus ``walk_offset`` lies in
    ``[low, high]``; on one edge ``same_edge_offset`` (``k`` if None) is added instead. ``cutoff`` is the
    least support of a transition. ``take_first`` reads only pairs whose ``pair_id`` is below it.
    """

    k: int = 21
    min_count: int = 3
    low: int = 180
    high: int = 250
    cutoff: int = 200
    read_len: int = 36
    same_edge_offset: int | None = None
    walk_offset: int = 0
    take_first: int | None = None
    with_prefix: bool = False
    canonical_only: bool = False
    iterations: int = 1

    def __post_init__(self) -> None:
        if self.k < 1 or self.min_count < 1 or self.low > self.high or self.iterations < 0:
            raise ValueError(f"bad parameters: {self}")

    @classmethod
    def of(cls, told: dict) -> AssemblyParams:
        """Parameters by name, of texts or values; unknown names and values of another kind are an error."""
        known, found = {f.name: f.type for f in fields(cls)}, {}
        for name, value in told.items():
            if name not in known:
                raise ValueError(f"no such parameter: {name}")
            found[name] = _value(name, known[name], value)
        return cls(**found)

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None) -> AssemblyParams:
        """Parameters of a JSON file, if one is named, and of the session's settings, which go before it."""
        told = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
        settings = {name: spark.conf.get(PREFIX + name, None) for name in (f.name for f in fields(cls))}
        return cls.of(told | {name: value for name, value in settings.items() if value is not None})

    @property
    def same_edge(self) -> int:
        return self.k if self.same_edge_offset is None else self.same_edge_offset

    def but(self, **changes) -> AssemblyParams:
        return replace(self, **changes)


def _value(name: str, kind: str, value: object) -> int | bool | None:
    text = str(value).strip().lower()
    if text in ("", "none", "null") and "None" in kind:
        return None
    if kind == "bool" and text in ("true", "false"):
        return text == "true"
    if kind != "bool" and not isinstance(value, bool) and text.removeprefix("-").isdigit():
        return int(text)
    raise ValueError(f"bad value of {name}: {value!r}")
