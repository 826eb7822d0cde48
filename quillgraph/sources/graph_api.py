"""A data source over recorded answers of a graph service.

spark.dataSource.register(GraphSource)
spark.read.format("graph").option("path", folder).load()

Each file holds one answer: a JSON list of {"data": {neo4j_type, id, source,
target, properties}}. Files are partitions, so a folder of many answers reads in
parallel; equality filters on neo4j_type are taken over by the reader, and reads are
tried again with growing pauses. Reading files needs them on a path that all
executors see.

.option("values", "asthma\\nflu") asks the service itself instead: the types it knows
once, then the neighbourhood of each value of ``attribute`` (name) of nodes of
``type`` (Disease), a partition each. .option("service", "module:name") names what
makes a service, a call of (path) that returns an object with get(end_point, params);
the default replays a folder of recorded answers, path + end point + ".json",
and keeps to the filters and cutoffs as the service would.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillgraph.operators.ingest import CUTOFFS, EXCLUDED_TYPES
from quillgraph.schema import GRAPH_RECORD

TRIES = 5
PROPERTIES = ("name", "description", "identifier", "source", "sources", "preprint_list", "pmid_list")


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def patient(fetch: Callable[[str], str], what: str, pause: float = 0.1) -> str:
    """Tries up to TRIES times, each pause twice the one before."""
    for i in range(TRIES):
        try:
            return fetch(what)
        except OSError:
            if i == TRIES - 1:
                raise
            time.sleep(pause * 2**i)
    raise AssertionError


# The service's end points.
TYPES, NEIGHBOURHOOD = "/api/v1/types", "/api/v1/neighborhood/{}/{}/{}"


def parameters(types: dict, cutoffs: dict | None = None) -> dict:
    """A neighbourhood request's parameters: all types the service knows but the excluded ones, and the cutoffs."""
    return {"node_filters": [t for t in types["nodes"] if t not in EXCLUDED_TYPES], "edge_filters": list(types["edges"]), **(CUTOFFS if cutoffs is None else cutoffs)}


def within(data: dict, params: dict) -> bool:
    """Whether a record passes a request's filters and cutoffs. cutoff_<kind>_<property> holds for
    nodes of type <kind> and edges whose type ends in _<kind>: a number is a least value, a list
    the values allowed, of which a list must hold one. Records without the property pass."""
    kind = data.get("neo4j_type") or ""
    if kind not in params["edge_filters" if "_" in kind else "node_filters"]:
        return False
    for name, bound in params.items():
        about, _, property_ = name.removeprefix("cutoff_").partition("_")
        if not name.startswith("cutoff_") or kind.rpartition("_")[2] != about:
            continue
        value = (data.get("properties") or {}).get(property_)
        if value is None:
            continue
        if isinstance(bound, list):
            if not set(value if isinstance(value, list) else [value]) & set(bound):
                return False
        elif float(value) < bound:
            return False
    return True


class Recorded:
    """A service's answers from a folder; a value without a file has no neighbourhood."""

    def __init__(self, path: str):
        self.path = path

    def get(self, end_point: str, params: dict | None = None) -> object:
        file = self.path + end_point + ".json"
        if params is not None and not os.path.exists(file):
            return []
        answer = json.loads(read_file(file))
        return answer if params is None else [item for item in answer if within(item["data"], params)]


def neighbourhood(service, kind: str, attribute: str, value: str, cutoffs: dict | None = None) -> list[dict]:
    """The records around a node: the types request, then the neighbourhood request, each tried again if it fails."""
    types = patient(lambda end: service.get(end, None), TYPES)
    end = NEIGHBOURHOOD.format(kind, attribute, quote(value, safe=" "))
    return patient(lambda e: service.get(e, parameters(types, cutoffs)), end)


class Answer(InputPartition):
    """A recorded answer's file, or a value to ask the service for."""

    def __init__(self, path: str, asked: bool = False):
        self.path, self.asked = path, asked


class GraphReader(DataSourceReader):
    def __init__(self, path: str, fetch: Callable[[str], str] = read_file, options: dict | None = None):
        self.path, self.fetch, self.types, self.options = path, fetch, None, options or {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("neo4j_type",):
                self.types = {f.value} if self.types is None else self.types & {f.value}
            elif isinstance(f, In) and f.attribute == ("neo4j_type",):
                self.types = set(f.value) if self.types is None else self.types & set(f.value)
            else:
                yield f

    def partitions(self) -> list[Answer]:
        if "values" in self.options:
            return [Answer(v, True) for v in dict.fromkeys(self.options["values"].split("\n")) if v]
        return [Answer(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".json")]

    def read(self, partition: Answer) -> Iterator[tuple]:
        if partition.asked:
            module, _, name = self.options.get("service", f"{__name__}:Recorded").partition(":")
            service = getattr(importlib.import_module(module), name)(self.path)
            items = neighbourhood(service, self.options.get("type", "Disease"), self.options.get("attribute", "name"), partition.path)
        else:
            items = json.loads(patient(self.fetch, partition.path))
        for item in items:
            data = item["data"]
            if self.types is not None and data.get("neo4j_type") not in self.types:
                continue
            yield (data.get("neo4j_type"), _text(data.get("id")), _text(data.get("source")), _text(data.get("target")), _properties(data.get("properties") or {}))


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else str(value)


def _properties(p: dict) -> tuple:
    """``source`` may be a text or a list, ``sources`` a list or a text (its characters, as joining takes it)."""
    out = {k: p.get(k) for k in PROPERTIES}
    if isinstance(out["source"], list):
        out["source"] = ", ".join(map(str, out["source"]))
    if out["sources"] is not None:
        out["sources"] = list(map(str, out["sources"]))
    return tuple(out[k] if k == "sources" else _text(out[k]) for k in PROPERTIES)


class GraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph"

    def schema(self) -> str:
        return GRAPH_RECORD

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options["path"], options=dict(self.options))
