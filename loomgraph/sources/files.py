"""Text folders, JSON lines, and the artifacts of an index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, type string, answer string, supporting_docs array<string>"


def load_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Rows (doc_id, text): whole UTF-8 files, doc_id being the file's stem."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.url_decode(name).alias("doc_id"), F.col("value").alias("text"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(QUESTION).json(path)


@dataclass
class IndexConfig:
    """Settings of a build."""

    # The defaults
    chunk_size: int = 300
    overlap: int = 50
    entity_types: list[str] = field(default_factory=lambda: ["ORGANIZATION", "PERSON", "PROJECT", "LOCATION", "EVENT"])
    max_gleanings: int = 1
    alias_threshold: float = 0.9
    summarize_max_tokens: int = 150
    max_cluster_size: int = 10
    report_max_tokens: int = 4000
    extract_claims: bool = True
    seed: int = 42
    embedder: str = "hashing:512"


TABLES = (
    "text_units", "entities", "entity_descriptions", "entity_units", "entity_aliases", "relationships", "relationship_descriptions", "relationship_units", "communities",
    "community_reports", "claims", "entity_vectors", "relationship_vectors", "text_unit_vectors", "report_vectors",
)


@dataclass
class Index:
    """The tables of an index, all lazy."""

    config: IndexConfig
    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def community(self, community: str) -> DataFrame:
        return self.communities.where(F.col("community") == community)

    def report(self, community: str) -> DataFrame:
        return self.community_reports.where(F.col("id") == community)

    def communities_of(self, name: str) -> DataFrame:
        return self.communities.where(F.col("name") == name)


def save_index(index: Index, folder: str) -> None:
    """One Parquet folder per table, and the configuration as one line of JSON."""
    for name, df in index.tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(index.tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(asdict(index.config)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def load_index(spark: SparkSession, folder: str) -> Index:
    """The inverse of save_index; unknown settings are dropped."""
    held = json.loads(spark.read.text(f"{folder}/config").first()[0])
    config = IndexConfig(**{k: v for k, v in held.items() if k in {f.name for f in fields(IndexConfig)}})
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return path.getFileSystem(conf).exists(path)

    return Index(config, {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES if there(t)})


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, line): the elements of a GraphML document, nodes (part 1) and edges (part 2), made by the tasks."""

    def element(kind: str, ends: dict[str, str]):
        def run(batches):
            for b in batches:
                out = []
                for row in b["row"]:
                    held = json.loads(row)
                    e = ET.Element(kind, {a: str(held.pop(c)) for a, c in ends.items()})
                    for k, v in held.items():
                        ET.SubElement(e, "data", key=k).text = json.dumps(v) if isinstance(v, (list, dict)) else str(v)
                    out.append(ET.tostring(e, encoding="unicode"))
                yield pd.DataFrame({"line": out})

        return run

    n = nodes.select(F.to_json(F.struct("*")).alias("row")).mapInPandas(element("node", {"id": "name"}), "line string").select(F.lit(1).alias("part"), "line")
    e = edges.select(F.to_json(F.struct("*")).alias("row")).mapInPandas(element("edge", {"source": "u", "target": "v"}), "line string").select(F.lit(2).alias("part"), "line")
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML file: the tasks write its elements as text, which is then joined on the driver part by part, never held as a whole.

    Null attributes are left out, lists and structs are written as JSON. `path` is a file of the driver's machine.
    """
    keys = "".join(ET.tostring(ET.Element("key", {"id": f.name, "for": kind, "attr.name": f.name, "attr.type": "string"}), encoding="unicode") for kind, df, skip in (("node", nodes, {"name"}), ("edge", edges, {"u", "v"})) for f in df.schema if f.name not in skip)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">\n')
        for r in graphml_lines(nodes, edges).toLocalIterator():
            out.write(r["line"] + "\n")
        out.write("</graph></graphml>\n")
