"""The ranking query: candidate mappings between two schemas, against the ledger's decisions."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.registry import FunctionLibrary
from ..operators import hierarchy, ledger, lint, vectors
from ..sources.model import Schema

#: Turns texts into vectors; the flag says whether they are queries (the source) or passages (the target).
Embedder = Callable[[list[str], bool], np.ndarray]


def prefixed(texts: list[str], model: str, query: bool) -> list[str]:
    """Model families that want a lead word get it."""
    low = model.lower()
    return [f"{'query' if query else 'passage'}: {t}" for t in texts] if "e5" in low and "e5se" not in low else texts


def hashing_embedder(dim: int = 256) -> Embedder:
    """Character trigrams, hashed: deterministic, and needs no model file."""
    import zlib

    def embed(texts: list[str], query: bool) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            t = f"  {t.lower()} "
            for j in range(len(t) - 2):
                out[i, zlib.crc32(t[j : j + 3].encode()) % dim] += 1
        return out

    return embed


def model_embedder(model: str) -> Embedder:
    """A sentence-embedding model by name, with the lead words of its family; ValueError where it does not load."""
    try:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
    except Exception as error:  # a missing library, a missing file and a broken model alike
        raise ValueError(f"the embedding model {model!r} does not load: {error}") from error
    return lambda texts, query: np.asarray(loaded.encode(prefixed(texts, model, query)), float)


def embedded(spark: SparkSession, schema: Schema, embed: Embedder, query: bool) -> DataFrame:
    """(node_id, label, datatype, pos, vector, structure) of a schema's nodes."""
    nodes = schema.nodes(spark).orderBy("pos").collect()
    if not nodes:
        raise ValueError(f"the schema {schema.name} has no nodes")
    found = np.asarray(embed([n.text for n in nodes], query), float)
    base = spark.createDataFrame([(n.node_id, n.label, n.datatype, n.pos, v.tolist()) for n, v in zip(nodes, found, strict=True)], "node_id string, label string, datatype string, pos int, vector array<double>")
    features = hierarchy.structural_features(schema.class_rows(spark), schema.slot_rows(spark), schema.class_slot_rows(spark))
    features = features.groupBy("node").agg(F.min_by(F.array("f0", "f1", "f2", "f3", "f4"), "f0").alias("structure"))
    key = F.concat(F.lit(f"{schema.name}:"), "node").alias("node_id")
    return base.join(features.select(key, "structure"), "node_id", "left")


def suggest(spark: SparkSession, source: Schema, target: Schema, log: DataFrame, embed: Embedder | None = None, top_k: int = 5, min_score: float = 0.0, structural_weight: float = 0.2, policies: dict[str, str] | None = None, library: FunctionLibrary | None = None) -> DataFrame:
    """Candidate mapping rows, best first for each source node.

    Decided subjects and rejected pairs are left out after ranking, without others moving up.  Pairs that
    the log knows keep its latest predicate and justification.
    """
    embed = embed or hashing_embedder()
    left, right = embedded(spark, source, embed, True), embedded(spark, target, embed, False)
    a = left.select(F.col("node_id").alias("subject_id"), "vector", "structure")
    b = right.select(F.col("node_id").alias("object_id"), F.col("pos").alias("object_pos"), "vector", "structure")
    vectors.check_dimensions(a, b)
    has = [df.where(F.exists("structure", lambda x: x != 0)).limit(1).count() > 0 for df in (a, b)]
    if has[0] != has[1]:
        warnings.warn("only one schema has structure; ranking by text alone", stacklevel=2)
    blending = all(has) and structural_weight > 0
    if not blending:
        a, b = a.drop("structure"), b.drop("structure")
    ranked = vectors.best_candidates(a, b, top_k, min_score, structural_weight)
    kept = ledger.filter_decided(ranked, log)
    told = ledger.refresh(kept, log, vocab.COMPOSITE if blending else vocab.LEXICAL)
    for side, nodes in (("subject", left), ("object", right)):
        info = nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("datatype").alias(f"{side}_datatype"))
        told = told.join(info, f"{side}_id", "left")
    null = F.lit(None)
    rows = told.select(
        *[
            {"confidence": F.col("score"), "subject_label": F.coalesce("subject_label", F.lit("")), "object_label": F.coalesce("object_label", F.lit(""))}
            .get(f.name, F.col(f.name) if f.name in told.columns else null.cast(f.dataType))
            .alias(f.name)
            for f in vocab.MAPPING.fields
        ],
        "rank",
    )
    order = left.select(F.col("node_id").alias("subject_id"), F.col("pos").alias("__pos"))
    filled = lint.populate_functions(rows, policies or {}, library or FunctionLibrary.builtins())
    return filled.join(order, "subject_id").orderBy("__pos", "rank").select(*vocab.MAPPING_COLUMNS)
