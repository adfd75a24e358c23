"""What a job is put together from, by name: embedders, annotators, item loaders and domains."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Named functions of one kind. `protocol` says what they take and give; names are unique, unknown ones raise a KeyError that lists what there is."""

    def __init__(self, kind: str, protocol: str) -> None:
        self.kind, self.protocol = kind, protocol
        self._of: dict[str, Any] = {}

    def register(self, name: str, what: Any = None) -> Any:
        """Registers `what`, or as a decorator the function that follows."""
        if what is None:
            return lambda f: self.register(name, f)
        if name in self._of:
            raise ValueError(f"{self.kind} {name} is registered already")
        if not callable(what) and not isinstance(what, Domain):
            raise TypeError(f"{self.kind} {name} isn't callable: {self.protocol}")
        self._of[name] = what
        return what

    def get(self, name: str) -> Any:
        if name not in self._of:
            raise KeyError(f"no {self.kind} {name}; there are: {', '.join(sorted(self._of)) or 'none'}")
        return self._of[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._of))

    def __contains__(self, name: str) -> bool:
        return name in self._of


@dataclass(frozen=True)
class Domain:
    """A domain head that joins the router by name: its attribute and region, its classes (`none` among them lets it abstain), and where its items come from."""

    attr: str
    region: str
    classes: tuple[str, ...]
    items: Callable[[SparkSession, str], DataFrame] | None = None
    per_class: int = 16

    @property
    def abstains(self) -> bool:
        return "none" in self.classes


EMBEDDERS = Registry("embedder", "embed(texts: list[str]) -> list of equally long vectors, one a text; called inside tasks")
ANNOTATORS = Registry("annotator", "annotate(rows: DataFrame of row_id, ..) -> DataFrame of row_id, attr, value, leaf, score")
LOADERS = Registry("item loader", "load(spark, path) -> DataFrame of id, question, choices, gold_name, audio_path")
DOMAINS = Registry("domain", "a Domain")


def annotate(rows: DataFrame, *names: str) -> DataFrame:
    """Label records of several annotators over the same rows, each with its tool's name."""
    from pyspark.sql import functions as F

    out = None
    for name in names:
        got = ANNOTATORS.get(name)(rows).select("row_id", "attr", F.lower("value").alias("value"), F.coalesce("leaf", F.lit("")).alias("leaf"), F.round("score", 4).alias("score"), F.lit(name).alias("tool"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no annotator named")
    return out
