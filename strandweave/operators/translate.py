"""Labels and descriptions in another language, through a pluggable translator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TranslationError(RuntimeError):
    """The translator refused or failed."""


def texts(nodes: DataFrame) -> DataFrame:
    """(text): the distinct titles and descriptions to translate."""
    return nodes.select(F.explode(F.array("title", "description")).alias("text")).where("text is not null and text <> ''").distinct()


def apply(nodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Nodes with title and description from the dictionary (text, translated); a changed title goes to the
    front of the aliases unless it is among them."""
    told = dictionary.select("text", "translated")
    out = nodes.join(told.select(F.col("text").alias("title"), F.col("translated").alias("__t")), "title", "left").join(told.select(F.col("text").alias("description"), F.col("translated").alias("__d")), "description", "left")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    changed = F.col("__t").isNotNull() & (F.col("__t") != F.col("title")) & ~F.array_contains(aliases, F.col("title"))
    out = out.withColumn("aliases", F.when(changed, F.concat(F.array("title"), aliases)).otherwise(aliases))
    out = out.withColumn("title", F.coalesce("__t", "title")).withColumn("description", F.coalesce("__d", "description"))
    return out.select(*nodes.columns)


def translate(nodes: DataFrame, language: str, translator: Callable[[list[str]], list[str]]) -> DataFrame:
    """Nodes in English; a source in English passes untouched.  The translator sees each text once."""
    if language.upper().startswith("EN"):
        return nodes
    # a schema's texts: a few hundred, however large its data
    wanted = [r.text for r in texts(nodes).orderBy("text").collect()]
    try:
        done = translator(wanted) if wanted else []
    except Exception as error:
        raise TranslationError(f"translation failed: {error}") from error
    if len(done) != len(wanted):
        raise TranslationError(f"{len(wanted)} texts went out, {len(done)} came back")
    return apply(nodes, nodes.sparkSession.createDataFrame(list(zip(wanted, done, strict=True)), "text string, translated string"))
