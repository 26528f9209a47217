"""Long transcriptions as micro-batches: a recording's chunks in steps, each step's text written once.

A clock stream counts the steps, and its checkpoint knows which are over. A step that is run again, after a failure, writes
its own folder anew, so no text is there twice or missing. What has been written is the text so far, whatever happens next.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from scribelake.operators.signal import cut_samples
from scribelake.operators.text import render
from scribelake.operators.transcribe import Transcriber, transcribe_chunks

#: A recording is done in about so many steps: chunks of a step are transcribed in parallel, and between steps its text shows.
STEPS = 50


class FileSteps:
    """The steps of one recording, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder, key
        self.kind = "string"

    def lay_out(self, runs: DataFrame, chunks: DataFrame, steps: int = STEPS) -> int:
        """Writes the chunks (key, label, start, end) with their samples, in folders by step, and gives the number of steps.
        Samples are read once. Chunks of one recording are few, a row for some 12 s, so one task numbers them."""
        nth = F.row_number().over(Window.partitionBy(self.key).orderBy("start")) - 1
        per = F.greatest(F.ceil(F.count("*").over(Window.partitionBy(self.key)) / steps), F.lit(1))
        numbered = chunks.withColumn("step", F.floor(nth / per).cast("long"))
        cut_samples(runs, numbered, self.key).write.mode("overwrite").partitionBy("step").parquet(f"{self.folder}/chunks")
        self.kind = chunks.schema[self.key].dataType.simpleString()
        last = self.chunks().agg(F.max("step")).first()[0]
        return 0 if last is None else last + 1

    def chunks(self, step: int | None = None) -> DataFrame:
        schema = f"{self.key} {self.kind}, label int, start long, end long, samples array<smallint>, step long"
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/chunks")
        return rows if step is None else rows.where(F.col("step") == step)

    def parts(self) -> DataFrame:
        """What has been transcribed so far."""
        return self.spark.read.schema(f"{self.key} {self.kind}, seq long, label int, text string").option("recursiveFileLookup", "true").parquet(f"{self.folder}/parts")

    def text(self) -> str:
        found = render(self.parts(), [self.key]).first()
        return found["transcript"] if found else ""

    def run_step(self, step: int, make: Callable[[], Transcriber]) -> int:
        """Transcribes one step's chunks into its own folder, in place of what is there; gives the number of parts."""
        seen = Observation(f"step {step}")
        parts = transcribe_chunks(self.chunks(step), make, self.key).observe(seen, F.count("*").alias("parts"))
        parts.write.mode("overwrite").parquet(f"{self.folder}/parts/step-{step:06d}")
        return seen.get["parts"]

    def run(self, steps: int, make: Callable[[], Transcriber], begun: Callable[[int], None], done: Callable[[int], None], stop: threading.Event) -> None:
        """All steps that aren't over yet, in order. ``begun`` and ``done`` hear the steps; ``stop`` ends the stream between two
        of them or, as its jobs are cancelled, amid one. What breaks a step is raised here."""
        over = threading.Event()

        def micro_batch(batch: DataFrame, number: int) -> None:
            if number >= steps or stop.is_set():
                over.set()
                return
            begun(number)
            self.run_step(number, make)
            done(number)

        clock = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        query = clock.writeStream.foreachBatch(micro_batch).option("checkpointLocation", f"{self.folder}/clock").trigger(processingTime="0 seconds").start()
        try:
            while query.isActive and not over.wait(0.05):
                if stop.is_set():
                    break
        finally:
            query.stop()
        if not stop.is_set() and not over.is_set() and query.exception():
            raise query.exception()
