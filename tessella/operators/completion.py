"""Completions of prompts by a model that the caller brings, kept in a table so that no prompt is asked twice."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import ship

CACHE = "key string, model string, text string"
# Attempts for each prompt, and seconds of the first and the longest wait between them.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 2.0, 30.0

#: system (or none), prompt, temperature to the completion.
Completer = Callable[[str | None, str, float], str | None]


def key(model: str, system: Column, prompt: Column, temperature: float = 0.0) -> Column:
    """The address of a completion: everything that it depends on."""
    parts = F.struct(F.lit(model).alias("model"), system.alias("system"), prompt.alias("prompt"), F.lit(temperature).alias("temperature"))
    return F.sha1(F.to_json(parts, {"ignoreNullFields": "false"}))


def patiently(completer: Completer, wait: Callable[[float], None] = time.sleep) -> Completer:
    """The completer, asked again after growing waits when it raises; the last failure is raised."""

    def ask(system, prompt, temperature):
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return completer(system, prompt, temperature)
            except Exception:
                if attempt == ATTEMPTS:
                    raise
                wait(min(FIRST_WAIT * 2 ** (attempt - 1), LONGEST_WAIT))

    return ask


def completed(prompts: DataFrame, completer: Completer | None, model: str, cache: str, temperature: float = 0.0) -> DataFrame:
    """prompts (prompt, system if there is one, other columns) with text; without a completer text is null.

    Each different prompt that the table at `cache` does not hold is asked once, on the executors, and appended there;
    what is null is not kept, so that it is asked again another time. Null prompts are not asked.
    """
    if completer is None:
        return prompts.withColumn("text", F.lit(None).cast("string"))
    spark = prompts.sparkSession
    ship(spark)
    system = F.col("system") if "system" in prompts.columns else F.lit(None).cast("string")
    keyed = prompts.withColumn("key", F.when(F.col("prompt").isNotNull(), key(model, system, F.col("prompt"), temperature)))

    def held() -> DataFrame:
        try:
            return spark.read.schema(CACHE).parquet(cache).groupBy("key").agg(F.min("text").alias("text"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "key string, text string")

    def run(batches):
        ask = patiently(completer)
        for batch in batches:
            keys, systems, texts = (c.to_pylist() for c in batch.columns)
            found = [ask(s, p, temperature) for s, p in zip(systems, texts)]
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([model] * len(keys), pa.string()), pa.array(found, pa.string())], names=["key", "model", "text"])

    missing = keyed.where("key IS NOT NULL").select("key", system.alias("system"), "prompt").dropDuplicates(["key"]).join(held(), "key", "left_anti")
    missing.select("key", "system", "prompt").mapInArrow(run, CACHE).where("text IS NOT NULL").write.mode("append").parquet(cache)
    return keyed.join(held(), "key", "left").drop("key")


def as_json(text: Column, schema: str) -> Column:
    """The first object or list in a completion, which may have other words around it; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")), schema)
