"""The background trigger of consolidation as a stream: per-bank state that decides, fact by fact, when a bank is due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memspark.operators.pairs import shared_folder

#: Unconsolidated facts that make a bank due, and seconds after an evaluation in which none follows.
MIN_FACTS, COOLDOWN = 32, 30.0

DECISIONS = "bank_id long, evaluated_at double, waiting long, due boolean"


def decide(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row for each evaluation of a bank. Facts (second, open) come in order of time, those that aren't open first within a second; an evaluation within the cooldown of
    the one before doesn't happen, one below the threshold restarts it all the same, and one that is due empties the count."""
    waiting, last = state.get if state.exists else (0, float("-inf"))
    out = []
    facts = pd.concat(list(rows)).sort_values(["second", "open"], kind="stable")
    for second, open_ in zip(facts["second"], facts["open"]):
        waiting += int(open_)
        if second - last < COOLDOWN:
            continue
        due = waiting >= MIN_FACTS
        out.append((key[0], float(second), waiting, due))
        last, waiting = float(second), 0 if due else waiting
    state.update((waiting, last))
    if out:
        yield pd.DataFrame(out, columns=["bank_id", "evaluated_at", "waiting", "due"])


def trigger(facts: DataFrame) -> DataFrame:
    """Decisions over a stream of facts (bank_id, second, open); the state is in the stream's checkpoint and survives restarts."""
    return facts.groupBy("bank_id").applyInPandasWithState(decide, DECISIONS, "waiting long, last double", "append", GroupStateTimeout.NoTimeout)


def replay(facts: DataFrame, folder: str | None = None) -> DataFrame:
    """The decisions over a table of facts, replayed as a stream that ends with its input."""
    spark = facts.sparkSession
    folder = folder or f"{shared_folder(spark)}/replay-{pd.Timestamp.now().value}"
    second = F.datediff("created_at", F.lit("1970-01-01").cast("date")) * 86400 + F.hour("created_at") * 3600 + F.minute("created_at") * 60 + F.second("created_at")
    open_ = F.col("network").isin("world", "experience") & F.col("consolidated_at").isNull()
    facts.select("bank_id", second.cast("double").alias("second"), open_.alias("open")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("bank_id long, second double, open boolean").parquet(f"{folder}/in")
    run = trigger(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(DECISIONS).parquet(f"{folder}/out")
