"""Table schemas and closed vocabularies of the graph model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The closed vocabularies of the model.
KINDS = ["function", "method", "class", "module", "file", "doc", "concept"]
RELATIONS = ["calls", "imports", "inherits", "implements", "references", "contains"]
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
ENDPOINT_KINDS = ["http", "rpc", "queue", "lib"]

NODES = "graph string, id string, label string, kind string, file string, line int, community int"
EDGES = "graph string, src string, dst string, relation string, confidence string"
COMMUNITIES = "graph string, id int, label string, members array<string>"
ENDPOINTS = "service string, direction string, kind string, key string, display string, node string, file string, line int, confidence string, source string"
RAW_CALLS = "graph string, from_id string, callee string, line int, file string, imports array<string>"
FILES = "graph string, path string, rel_path string, lang string, length long, content binary"
_EP = "array<struct<kind:string,key:string,display:string,node:string,file:string,line:int,confidence:string,source:string>>"
DOCUMENT = (
    "version string, generated_at string, root string, nodes array<struct<id:string,label:string,kind:string,file:string,line:int,community:int>>, "
    "edges array<struct<from:string,to:string,relation:string,confidence:string>>, communities array<struct<id:int,label:string,members:array<string>>>, "
    f"provides {_EP}, consumes {_EP}"
)


@dataclass
class Graph:
    """A set of graphs as tables; every row names its graph, so many repositories are one job."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None
    endpoints: DataFrame | None = None


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
