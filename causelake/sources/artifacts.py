"""Artifacts: Parquet sections and a JSON manifest, written and read through Spark's file systems.

The manifest is one row of text in a Parquet section of its own, so any store that Spark reads holds
an artifact; sections are read one at a time and column by column.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.errors import DataError

FORMAT = 2
QUERY_CLASSES = (
    "AverageEffect", "ConditionalEffect", "InterventionalDistribution", "PathSpecificEffect", "ResponseCurve", "DiscontinuityEffect", "PulseEffect", "SustainedEffect", "MediationEffect", "Counterfactual",
    "TemporalMediationEffect", "AverageDerivative", "PointDerivative", "Elasticity", "SemiElasticity", "DirectionalDerivative", "ResponseJacobian", "InterventionResponse",
)


def write_artifact(path: str, kind: str, sections: Mapping[str, DataFrame], meta: Mapping | None = None) -> None:
    """Sections first, the manifest last: an artifact without manifest is not complete."""
    if not sections:
        raise DataError("an artifact has at least one section")
    described, spark = {}, next(iter(sections.values())).sparkSession
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{path}/sections/{name}")
        back = spark.read.parquet(f"{path}/sections/{name}")
        s = back.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h")).first()
        described[name] = {"rows": s["n"], "checksum": str(s["h"]), "schema": json.loads(back.schema.json())}
    manifest = json.dumps({"format": FORMAT, "kind": kind, "meta": dict(meta or {}), "sections": described})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return migrate(json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"]))


def read_section(spark: SparkSession, path: str, name: str, verify: bool = False) -> DataFrame:
    """One section, lazily; with ``verify`` its rows are checked against the manifest."""
    found = read_manifest(spark, path)["sections"]
    if name not in found:
        raise DataError(f"no section {name!r}")
    df = spark.read.parquet(f"{path}/sections/{name}")
    if verify:
        s = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        if s["n"] != found[name]["rows"] or str(s["h"]) != found[name]["checksum"]:
            raise DataError(f"section {name!r} does not match its manifest")
    return df


def migrate(manifest: dict) -> dict:
    """Older manifests in today's form; a newer one is refused."""
    if manifest.get("format", 1) > FORMAT:
        raise DataError(f"artifact format {manifest['format']}")
    if manifest.get("format", 1) == 1:  # sections were a list of names
        manifest = manifest | {"format": 2, "sections": {n: {} for n in manifest["sections"]}, "meta": manifest.get("meta", {})}
    return manifest


def write_posterior(path: str, draws: DataFrame, meta: Mapping) -> None:
    """Draws as a section, what they are of in the manifest: readable without the draws."""
    write_artifact(path, "posterior", {"draws": draws}, meta)


def write_model(path: str, graph, parameters: DataFrame, result: DataFrame | None = None) -> None:
    from causelake.sources.graphs import to_json

    write_artifact(path, "model", {"parameters": parameters, **({"result": result} if result is not None else {})}, {"graph": to_json(graph)})


def read_model(spark: SparkSession, path: str):
    """(graph, parameters) of a written model; linear mechanisms are restored by ``linear_model``."""
    from causelake.sources.graphs import from_json

    return from_json(read_manifest(spark, path)["meta"]["graph"]), read_section(spark, path, "parameters")


def linear_parameters(model, spark: SparkSession) -> DataFrame:
    """``node, term, value`` of linear mechanisms: ``intercept``, ``sd`` and a coefficient a parent."""
    rows = [(n, k, float(v)) for n, m in model.mechanisms.items() for k, v in {"(intercept)": m.intercept, "(sd)": m.sd, **m.coefficients}.items()]
    return spark.createDataFrame(rows, "node string, term string, value double")


def linear_model(graph, parameters: DataFrame):
    """The model of written linear parameters (one row a term, as many as arrows and nodes)."""
    from causelake.operators.scm import Linear, Model

    held: dict[str, dict[str, float]] = {}
    for r in parameters.collect():
        held.setdefault(r["node"], {})[r["term"]] = r["value"]
    return Model(graph, {n: Linear(v.pop("(intercept)"), {k: b for k, b in v.items() if k != "(sd)"}, v["(sd)"]) for n, v in held.items()})


def payload(kind: str, query, variables: list[str], result: Mapping | None = None) -> str:
    """A query or a result as a document of its own: JSON with the class and fields of the query, and the variables by position."""
    from dataclasses import asdict, is_dataclass

    if not is_dataclass(query) or kind not in ("query", "result"):
        raise DataError("a payload is a query or a result, of a query class")
    held: list = [asdict(query)]
    named = set()
    while held:  # names may stand anywhere in the fields
        v = held.pop()
        held += v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else []
        named |= {v} if isinstance(v, str) and v in variables else set()
    body = {"format": FORMAT, "kind": kind, "class": type(query).__name__, "fields": asdict(query), "variables": variables, "uses": sorted({variables.index(v) for v in named})}
    return json.dumps(body | ({"result": dict(result)} if result is not None else {}), sort_keys=True)


def read_payload(text: str):
    """(query, variables, result or None); an unknown class or a newer format is refused."""
    from causelake import api

    body = json.loads(text)
    if body.get("format", 0) > FORMAT:
        raise DataError(f"payload format {body['format']}")
    if body.get("class") not in QUERY_CLASSES:
        raise DataError(f"no query class {body.get('class')!r}")
    tuples = lambda v: tuple(map(tuples, v)) if isinstance(v, list) else v
    return getattr(api, body["class"])(**{k: tuples(v) for k, v in body["fields"].items()}), body["variables"], body.get("result")


def ipc_section(df: DataFrame) -> DataFrame:
    """Rows as Arrow IPC streams, ``part, rows, stream``: one complete stream a batch, which any Arrow reader opens."""
    import pyarrow as pa

    def streams(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "rows", "stream"])

    return df.mapInArrow(streams, "part int, rows long, stream binary")


def from_ipc(section: DataFrame, schema: str) -> DataFrame:
    """The rows of IPC streams."""
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            for stream in b.column("stream"):
                yield from pa.ipc.open_stream(pa.py_buffer(stream.as_py()))

    return section.select("stream").mapInArrow(rows, schema)
