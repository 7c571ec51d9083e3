"""A ledger of what model services said: each prompt of a kind is asked once, whatever asks for it and however often.

The ledger is a table of key (a hash of kind and prompt), prompt and response in a folder for each kind. What is missing is asked in
blocks, each of which Spark appends in one write when it is whole, so a run that is killed has lost one block at most, and the next one
asks for the rest. Two runs at once may both ask for a prompt; of two responses the least counts, for all that read it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import checkpointed
from foliant.sources.providers import BATCH_ROWS, TRIES, WAIT_S, Chat, with_retries

#: Calls of a block at least, and blocks at most; tasks that call at once.
BLOCK_CALLS, MOST_BLOCKS, TASKS = 256, 1000, 4
SCHEMA = "key string, prompt string, response string, kind string"


class Ledger:
    """ask(df, kind) of providers.asker, with memory. per_second bounds the calls of all tasks together; valid says whether a response will do."""

    def __init__(self, spark: SparkSession, path: str, provider: Chat, per_second: float | None = None, tasks: int = TASKS, block: int = BLOCK_CALLS, tries: int = TRIES, wait: float = WAIT_S, valid: Callable[[str], bool] = bool, prompt: str = "prompt", question: str = "question"):
        self.spark, self.path, self.provider, self.per_second, self.tasks, self.block = spark, path, provider, per_second, tasks, block
        self.tries, self.wait, self.valid, self.prompt, self.question = tries, wait, valid, prompt, question

    def read(self) -> DataFrame:
        """key, prompt, response, kind: a row for each prompt that has a response."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("key", "kind").agg(F.min("prompt").alias("prompt"), F.min("response").alias("response")).select("key", "prompt", "response", "kind")

    def __call__(self, df: DataFrame, kind: str) -> DataFrame:
        """df with response. A prompt that gets no valid response in so many tries fails, after what was answered before is kept; a null one is empty."""
        said = F.coalesce(F.col(self.prompt if self.prompt in df.columns else self.question), F.lit(""))
        keyed = checkpointed(df.withColumns({"_said": said, "_key": F.sha2(F.concat(F.lit(kind), F.lit("\0"), said), 256)}))
        known = self.read().filter(F.col("kind") == kind).select("key")
        missing = checkpointed(keyed.groupBy(F.col("_key").alias("key")).agg(F.min("_said").alias("prompt")).join(known, "key", "left_anti"))
        n = missing.count()
        blocks = min(MOST_BLOCKS, -(-n // self.block))
        for b in range(blocks):
            part = missing.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).repartition(self.tasks, "key")
            made = part.mapInPandas(self._caller(kind), "key string, prompt string, response string")
            made.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(self.path)
        own = self.read().filter(F.col("kind") == kind).select(F.col("key").alias("_key"), "response")
        return keyed.join(own, "_key").drop("_key", "_said")

    def _caller(self, kind: str):
        provider, tries, wait, valid = self.provider, self.tries, self.wait, self.valid
        pause = 0.0 if not self.per_second else self.tasks / self.per_second
        most = BATCH_ROWS if not pause else max(1, min(BATCH_ROWS, int(1 / pause)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                said, out, begun = frame["prompt"].tolist(), [], time.monotonic()
                for at in range(0, len(said), most):
                    part = said[at : at + most]
                    if pause and (ahead := begun + at * pause - time.monotonic()) > 0:
                        time.sleep(ahead)

                    def ask(part=part) -> list[str]:
                        got = provider.complete(kind, part)
                        if len(got) != len(part) or not all(got) or not all(map(valid, got)):
                            raise ValueError(f"a response of kind {kind} is missing or not valid")
                        return got

                    out += with_retries(ask, tries, wait)
                yield frame.assign(response=out)[["key", "prompt", "response"]]

        return run
