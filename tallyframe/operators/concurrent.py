"""Many calls of a model at once: bounded by a number of open calls and a rate that all tasks share."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .inference import ANSWER, Client


#: Requests of a task where the number of tasks is not given.
SHARE = 100_000


class Retryable(Exception):
    """Raised by a client for a failure that may pass; ``wait`` is the provider's own advice in seconds."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


class Pace:
    """Lets calls of several threads start no sooner than ``1 / rate`` seconds after one another."""

    def __init__(self, rate: float | None):
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, time.monotonic(), threading.Lock()

    def wait(self) -> None:
        with self.lock:
            start = max(self.next, time.monotonic())
            self.next = start + self.gap
        time.sleep(max(0.0, start - time.monotonic()))


def _call(client: Client, pace: Pace, tries: int, first_wait: float, model: str, system: str, text: str) -> tuple[str | None, float, str | None]:
    """The answer or the error of one request, tried again with growing waits while the failure may pass."""
    began = time.perf_counter()
    for k in range(tries):
        pace.wait()
        try:
            return client(model, system, text), time.perf_counter() - began, None
        except Retryable as e:
            error = f"{type(e).__name__}: {e}"[:200]
            if k + 1 < tries:
                time.sleep(e.wait if e.wait is not None else first_wait * 2**k * (1 + random.random()))
        except Exception as e:  # noqa: BLE001  any failure of a call is a row
            return None, time.perf_counter() - began, f"{type(e).__name__}: {e}"[:200]
    return None, time.perf_counter() - began, error


def answer_concurrently(requests: DataFrame, make_client: Callable[[], Client], system: str = "", open_calls: int = 8, tries: int = 4, first_wait: float = 0.5, calls_per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """As ``inference.answer``, with up to ``open_calls`` calls of each of ``tasks`` tasks open at once.

    Without ``tasks``, requests are counted, and there are as many tasks as cores, or more so that none has many more than ``SHARE`` requests.

    Requests are dealt to ``tasks`` tasks, and each starts calls at its share of ``calls_per_second``, repeats included: however few or many of
    them run together, all of them stay within it. A task has at most ``open_calls`` requests in memory beside its batch, and
    gives their answers in the order of the requests. A request that fails for good is a row with its error. The client must
    allow calls from several threads; a task that is run again calls again.
    """
    if tasks is None:
        tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // SHARE))
    rows = requests.select("task", "model", "item_id", "user_content").repartition(tasks, "task", "model", "item_id")
    names = [c.split()[0] for c in ANSWER.split(", ")]
    share = calls_per_second / tasks if calls_per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, pace, waiting = make_client(), Pace(share), deque[tuple[tuple, Future]]()
        given = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        done: list[tuple] = []

        def take() -> None:
            key, future = waiting.popleft()
            done.append((*key, *future.result()))

        with ThreadPoolExecutor(open_calls) as pool:
            for task, model, item, text in given:
                if len(waiting) >= open_calls:
                    take()
                waiting.append(((task, model, item), pool.submit(_call, client, pace, tries, first_wait, model, system, text)))
                if len(done) >= 1_000:
                    yield batch_of(done)
                    done.clear()
            while waiting:
                take()
        if done:
            yield batch_of(done)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, ANSWER)
