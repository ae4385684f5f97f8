"""Calls to models as stages over prompt columns."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class ModelClient(Protocol):
    def invoke(self, system: str, human: str) -> str: ...


class Timeout(Exception):
    """A call took too long."""


@dataclass(frozen=True)
class Calls:
    """Bounds of a model call: retries on timeout only, any other failure is a null response at once.

    With ``growth`` over 1 the pause grows by it up to ``longest`` seconds, and with
    ``any_error`` all failures are tried again.
    """

    timeout: float = 60.0
    attempts: int = 3
    pause: float = 1.0
    growth: float = 1.0
    longest: float = 10.0
    any_error: bool = False

    def __call__(self, client: ModelClient, system: str, human: str) -> str | None:
        return self.tried(client, system, human)[0]

    def tried(self, client: ModelClient, system: str, human: str) -> tuple[str | None, str | None]:
        """The response and, if there is none, the last error."""
        error = "no attempt"
        for k in range(self.attempts):
            try:
                return self._once(client, system, human), None
            except Exception as e:  # noqa: BLE001  a failed call is data here
                error = "timeout" if isinstance(e, Timeout) else f"{type(e).__name__}: {e}"
                if not (self.any_error or isinstance(e, Timeout)):
                    break
                if k + 1 < self.attempts:
                    time.sleep(min(self.longest, self.pause * self.growth**k))
        return None, error

    def _once(self, client: ModelClient, system: str, human: str) -> str:
        box: list = []

        def call() -> None:
            try:
                box.append((True, client.invoke(system, human)))
            except Exception as e:  # noqa: BLE001
                box.append((False, e))

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(self.timeout)
        if not box:
            raise Timeout
        if not box[0][0]:
            raise box[0][1]
        return box[0][1]


#: Descriptions: three attempts whatever the failure, pauses from two to ten seconds.
DESCRIBE = Calls(pause=2.0, growth=2.0, any_error=True)
#: Checks of triplets: two attempts, pauses from one to five seconds.
CHECK = Calls(attempts=2, pause=1.0, growth=2.0, longest=5.0, any_error=True)


def with_response(df: DataFrame, make: Callable[[], ModelClient], system: str, prompt: str, calls: Calls = Calls(), column: str = "response", parallel: int | None = None, error: str | None = None) -> DataFrame:
    """``df`` with the model's ``column`` to its ``prompt``; null where the call failed.

    With ``error``, a column of that name says why.  The client is made once a partition.  ``parallel`` partitions bound the
    number of calls at a time.  Filters belong before this stage, as the
    optimizer can't look into it.
    """
    at = df.columns.index(prompt)
    more = [column, *([error] if error else [])]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            said = [calls.tried(client, system, p.as_py()) if p.is_valid else (None, "no prompt") for p in batch.column(at)]
            new = [pa.array([x[k] for x in said], pa.string()) for k in range(len(more))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *more])

    return (df.repartition(parallel) if parallel else df).mapInArrow(run, schema)
