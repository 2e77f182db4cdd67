"""Datasets by name, from a configuration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.graph import Graph, Mapped, graph_of, open_graph
from .mapping import Tables
from .readers import read


class DataSourceNotFound(KeyError):
    pass


class UnknownDataSourceType(ValueError):
    pass


class DuplicateDataSourceType(ValueError):
    pass


Opener = Callable[[SparkSession, dict], Graph]


def _tables(spark: SparkSession, settings: dict) -> Graph:
    return Mapped(Tables(spark, settings["path"], tuple(settings["tables"])))


#: What a datasource's settings mean, by type. More can be registered by name.
TYPES: dict[str, Opener] = {
    "dataset": lambda spark, s: open_graph(spark, s["file"], s.get("keepInMemory", False)),
    "rdf": lambda spark, s: graph_of(read(spark, s["file"], s.get("format"), s.get("base", ""))),
    "tables": _tables,
}


@dataclass
class Catalog:
    spark: SparkSession
    title: str = ""
    base: str = ""
    prefixes: dict[str, str] = field(default_factory=dict)
    sources: dict[str, dict] = field(default_factory=dict)
    types: dict[str, Opener] = field(default_factory=lambda: dict(TYPES))
    opened: dict[str, Graph] = field(default_factory=dict)

    def register(self, name: str, opener: Opener) -> None:
        if name in self.types:
            raise DuplicateDataSourceType(name)
        self.types[name] = opener

    @staticmethod
    def from_json(spark: SparkSession, text: str, types: dict[str, Opener] | None = None) -> Catalog:
        """Keys: title, baseURL, datasourcetypes (name to a known type), datasources (title, type, description, settings), prefixes."""
        config = json.loads(text)
        out = Catalog(spark, config.get("title", ""), config.get("baseURL", ""), config.get("prefixes", {}), config.get("datasources", {}))
        known = dict(TYPES) | (types or {})
        for name, kind in config.get("datasourcetypes", {}).items():
            if kind not in known:
                raise UnknownDataSourceType(kind)
            out.register(name, known[kind])
        for s in out.sources.values():
            if s["type"] not in out.types:
                raise UnknownDataSourceType(s["type"])
        return out

    def graph(self, name: str) -> Graph:
        if name not in self.sources:
            raise DataSourceNotFound(name)
        if name not in self.opened:
            s = self.sources[name]
            self.opened[name] = self.types[s["type"]](self.spark, s.get("settings", {}))
        return self.opened[name]

    def index(self) -> DataFrame:
        """(name, title, description, url) of every dataset."""
        rows = [(n, s.get("title", n), s.get("description", ""), f"{self.base}/{n}") for n, s in sorted(self.sources.items())]
        return self.spark.createDataFrame(rows, "name string, title string, description string, url string")
