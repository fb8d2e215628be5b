"""Outside calls as tables: requests by samples, recorded attempts, what is still to be called, retries, resume, values read from responses.

A request is a row with a ``request_id``; an attempt is a row (request_id, attempt from 1, response, status, error).  What is to
be called next is a join of the two, so a stopped run goes on where its recorded attempts end.  Attempts are written by round
or by micro-batch into a folder of its own (``batch=n``), which a repeated batch replaces: each is recorded once.  A task that
runs again calls again; an outside service that must not see that needs the ``request_id`` as its idempotency key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import json_block, json_object, let

ATTEMPT = "request_id string, attempt int, response string, status string, error string"
#: One batch of requests -> a response each, in order; None is a failure.
Call = Callable[[pd.DataFrame], Sequence[str | None]]


def requests(units: DataFrame, unit: str, caller: str, samples: int = 1, version: str | None = None) -> DataFrame:
    """``units`` times ``samples``, with sample_index from 0 and request_id. Units without an id have no request."""
    rows = units.filter(F.col(unit).isNotNull()).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return rows.withColumn("request_id", F.concat_ws("_", F.lit(version), F.lit("judge"), F.col(unit).cast("string"), F.lit(caller), "sample_index"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """(request_id, attempts, status, response, error): the first success and its response, else 'failed' and the last error. ``attempts`` is the last number.

    Of attempts under one number, the smallest response and the greatest error count.
    """
    ok = F.col("status") == "success"
    first = F.min(F.when(ok, F.struct("attempt", "response")))
    per = attempts.groupBy("request_id").agg(F.max("attempt").alias("attempts"), first.alias("_first"), F.max(F.struct("attempt", "error")).alias("_last"))
    done = F.col("_first").isNotNull()
    return per.select("request_id", "attempts", F.when(done, "success").otherwise("failed").alias("status"), F.col("_first.response").alias("response"), F.when(~done, F.col("_last.error")).alias("error"))


def pending(requested: DataFrame, attempts: DataFrame, retries: int = 2) -> DataFrame:
    """Requests without a success and with attempts left, and the number of the next ``attempt``."""
    known = outcomes(attempts).select("request_id", F.col("attempts").alias("_n"), F.col("status").alias("_status"))
    rows = requested.join(known, "request_id", "left").filter("_status IS NULL OR _status <> 'success'")
    return rows.withColumn("attempt", F.coalesce("_n", F.lit(0)) + 1).filter(F.col("attempt") <= 1 + retries).drop("_n", "_status")


def dead_letters(requested: DataFrame, attempts: DataFrame, retries: int = 2) -> DataFrame:
    """Requests whose attempts are used up without a success, with the last error."""
    lost = outcomes(attempts).filter((F.col("status") == "failed") & (F.col("attempts") > retries)).select("request_id", "attempts", "error")
    return requested.join(lost, "request_id")


def attempted(todo: DataFrame, call: Call, size: int = 50) -> DataFrame:
    """One attempt of every row of ``todo``, in batches. Rows of a batch that fails are called one by one, so a bad row fails alone."""
    names = [c.split()[0] for c in ATTEMPT.split(", ")]

    def one(part: pd.DataFrame) -> tuple[str | None, str | None]:
        try:
            (response,) = call(part)
            return response, None if response is not None else "no response"
        except Exception as error:  # the outside world may raise anything
            return None, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                try:
                    got = list(call(part))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} responses to {len(part)} requests")
                    said = [(r, None if r is not None else "no response") for r in got]
                except Exception:
                    said = [one(part.iloc[i : i + 1]) for i in range(len(part))]
                out = part[["request_id", "attempt"]].assign(response=[r for r, _ in said], error=[e for _, e in said])
                out["status"] = ["success" if e is None else "failed" for e in out["error"]]
                yield out[names]

    return todo.mapInPandas(run, ATTEMPT)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts written under a folder; an empty one is begun where there is none."""
    spark.createDataFrame([], ATTEMPT).write.mode("overwrite").parquet(f"{folder}/batch=-1")
    return spark.read.schema(f"{ATTEMPT}, batch bigint").parquet(folder)


def run_pending(requested: DataFrame, call: Call, folder: str, retries: int = 2, size: int = 50) -> DataFrame:
    """Calls what is pending, a round for each attempt, and returns ``outcomes`` of all that is recorded; run again, it goes on."""
    spark = requested.sparkSession
    for _ in range(1 + retries):
        done = recorded(spark, folder)
        latest = done.agg(F.max("batch").alias("n")).first().n  # one number
        todo = pending(requested, done, retries)
        if todo.isEmpty():
            break
        attempted(todo, call, size).write.mode("overwrite").parquet(f"{folder}/batch={0 if latest is None else latest + 1}")
    return outcomes(recorded(spark, folder))


def stream_calls(stream: DataFrame, call: Call, folder: str, checkpoint: str, retries: int = 2, size: int = 50) -> StreamingQuery:
    """One attempt of each micro-batch's pending requests, recorded under the batch's number; a request that comes again after a failure is retried."""

    def save(batch: DataFrame, number: int) -> None:
        earlier = recorded(batch.sparkSession, folder).filter(F.col("batch") != number)
        todo = pending(batch.dropDuplicates(["request_id"]), earlier, retries)
        attempted(todo, call, size).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mutation(response: Column, current: Column) -> Column:
    """struct<mutated_value, mutation_type, reasoning, parse_success> that a response holds; one that can't be read, or holds nothing, leaves the current value."""

    def read(v: Column) -> Column:
        has = F.coalesce(v.isNotNull() & (F.schema_of_variant(v) != "OBJECT<>"), F.lit(False))
        get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
        missing = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNull()
        return F.struct(
            F.when(has & ~missing("mutated_value"), get("mutated_value")).otherwise(current).alias("mutated_value"),
            F.when(~has, "llm_parse_failed").when(missing("mutation_type"), "llm_generated").otherwise(get("mutation_type")).alias("mutation_type"),
            F.when(has, get("reasoning")).otherwise("LLM response could not be parsed").alias("reasoning"),
            has.alias("parse_success"),
        )

    return let(json_object(json_block(response)), read)
