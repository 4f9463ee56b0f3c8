"""Remote calls as an operator: an injected callable over batches, set up once per partition, with the retry policy."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallywright.schemas import DEFAULTS, Settings


class Throttled(Exception):
    """The service asks to come back later: the message goes back to the queue, without a retry."""


class Refused(Exception):
    """The service will never accept this input."""


def call_with_retries(call: Callable[[], object], settings: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> tuple[str, object, int]:
    """outcome (ok, yield, permanent, gemini_exhausted), result and number of calls."""
    for turn in range(settings.retries + 1):
        try:
            return "ok", call(), turn + 1
        except Throttled:
            return "yield", None, turn + 1
        except Refused:
            return "permanent", None, turn + 1
        except Exception:  # noqa: BLE001
            if turn < settings.retries:
                sleep(settings.backoff_s[turn])
    return "gemini_exhausted", None, settings.retries + 1


def with_adapter(frame: DataFrame, setup: Callable[[], Callable[[object], str]], column: str, output: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``frame`` with ``output``, ``outcome`` and ``calls``: what the callable that ``setup`` makes says to each value of ``column``.

    Cut the frame down to the rows that need the call before this, by caches and
    states: the planner can't see into it.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField(output, T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("calls", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = setup()
        for batch in batches:
            done = [call_with_retries(lambda v=value: call(v), settings) for value in batch[column]]
            yield batch.assign(**{output: [d[1] for d in done], "outcome": [d[0] for d in done], "calls": [d[2] for d in done]})

    return frame.mapInPandas(run, schema)
