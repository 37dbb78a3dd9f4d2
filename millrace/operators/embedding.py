"""The embedding seam: one model for resolver, clustering and retrieval, loaded once a Python worker and fed by batches.

`load` is called without arguments, on the executors, and returns embed(list of texts) -> matrix with a row for each text. A model that
can't be loaded or fails on a batch gives null vectors, never a failed job.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]
log = logging.getLogger("millrace.embedding")


class Model:
    """A loader that remembers what it loaded; broadcast, so that a worker's tasks share it."""

    def __init__(self, load: Callable[[], Embed], batch: int = 256):
        self.load, self.batch, self._embed, self._known = load, batch, None, {}

    def __getstate__(self):
        return cloudpickle.dumps(self.load), self.batch  # loaders may be local functions

    def __setstate__(self, state):
        self.load, self.batch = cloudpickle.loads(state[0]), state[1]
        self._embed, self._known = None, {}

    def vectors(self, texts: list[str]) -> list[np.ndarray | None]:
        """A vector for each text, in calls of at most `batch` texts."""
        out: list[np.ndarray | None] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            try:
                self._embed = self._embed or self.load()
                out += list(np.asarray(self._embed(part), float))
            except Exception as e:  # noqa: BLE001  whatever an injected model throws
                log.warning("embedding failed, vectors are null: %s", e)
                out += [None] * len(part)
        return out

    def fixed(self, name: str, texts: list[str]) -> list[np.ndarray | None]:
        """Vectors of texts that stay the same, embedded once a worker."""
        if name not in self._known:
            self._known[name] = self.vectors(texts)
        return self._known[name]


def broadcast(spark: SparkSession, load: Callable[[], Embed], batch: int = 256):
    return spark.sparkContext.broadcast(Model(load, batch))


def embed(rows: DataFrame, text: str, load: Callable[[], Embed], batch: int = 256) -> DataFrame:
    """rows with `embedding` (array of double): null where the text is null or the model fails."""
    model = broadcast(rows.sparkSession, load, batch)
    names = rows.columns

    def run(batches):
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for i, v in zip(at, model.value.vectors([texts[i] for i in at]), strict=True):
                out[i] = v
            yield pa.record_batch([*b.columns[: len(names)], pa.array(out, pa.list_(pa.float64()))], [*names, "embedding"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.select("*", F.col(text).alias("_text")).mapInArrow(run, f"{ddl}, embedding array<double>")
