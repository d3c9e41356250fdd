"""Scoring by a program outside Spark: one long-lived process a worker, a JSON line in, a JSON line out.

A process that hangs is ended after a time limit, one that dies is noticed at once; either is started anew a stated
number of times, then the fallback answers. What was scored before, under the same program and version, is not asked again.
"""

from __future__ import annotations

import atexit
import json
import queue
import subprocess
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Scorer:
    """A process that answers each line `{"id": n, "text": ...}` with `{"id": n, "score": ...}`."""

    def __init__(self, command: list[str], timeout: float = 30.0, restarts: int = 2, ready: float = 60.0):
        self.command, self.timeout, self.left, self.ready = command, timeout, restarts, ready
        self.process: subprocess.Popen | None = None
        self.asked = 0

    def _start(self) -> None:
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8", bufsize=1)
        self.lines: queue.Queue[str | None] = queue.Queue()
        source, sink = self.process.stdout, self.lines

        def read() -> None:
            for line in source:
                sink.put(line)
            sink.put(None)

        threading.Thread(target=read, daemon=True).start()

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            for pipe in (self.process.stdin, self.process.stdout):
                pipe.close()
            self.process = None

    def _once(self, text: str) -> float | None:
        """One answer; raises if the process is gone, silent for too long, or answers what is no answer."""
        wait = self.timeout
        if self.process is None:
            self._start()
            wait += self.ready
        self.asked += 1
        self.process.stdin.write(json.dumps({"id": self.asked, "text": text}) + "\n")
        self.process.stdin.flush()
        while True:
            line = self.lines.get(timeout=wait)
            if line is None:
                raise ConnectionError("the scorer ended")
            answer = json.loads(line)
            if answer.get("id") == self.asked:
                return None if answer.get("score") is None else float(answer["score"])

    def score(self, text: str) -> tuple[float | None, bool]:
        """(score, True), or (None, False) where the process can give none; a text that ends it is not tried again."""
        if self.process is None and self.left < 0:
            return None, False
        try:
            return self._once(text), True
        except (OSError, ValueError, queue.Empty):
            self.close()
            self.left -= 1
            return None, False


_HELD: dict[tuple, Scorer] = {}


def _scorer(command: tuple[str, ...], timeout: float, restarts: int) -> Scorer:
    key = (command, timeout, restarts)
    if key not in _HELD:
        _HELD[key] = Scorer(list(command), timeout, restarts)
        atexit.register(_HELD[key].close)
    return _HELD[key]


def stamp(command: list[str], files: DataFrame | None = None) -> str:
    """A version of a program: its command, and the sizes and times of the files (path, length, modified) that it reads, such as weights."""
    import hashlib

    held = [] if files is None else sorted(map(str, files.select("path", "length", F.col("modified").cast("string")).collect()))
    return hashlib.sha256(json.dumps([command, held]).encode()).hexdigest()


def scored(rows: DataFrame, column: str, command: list[str], version: str, cache: DataFrame | None = None, fallback: Callable[[str], float | None] | None = None, timeout: float = 30.0, restarts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows with score and scored_by, new cache rows).

    scored_by is cache, program, fallback or none. Each distinct text is asked once; the cache (key, version, score) is
    looked at first, and only a program's answers go into the new rows. Null texts have no score.
    """
    key = F.sha2(F.col(column), 256)
    wanted = rows.where(F.col(column).isNotNull()).select(key.alias("key"), F.col(column).alias("text")).dropDuplicates(["key"])
    known = (cache if cache is not None else rows.sparkSession.createDataFrame([], "key string, version string, score double")).where(F.col("version") == version).select("key", "score").dropDuplicates(["key"])
    words = tuple(command)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _scorer(words, timeout, restarts)
        for pdf in parts:
            out = []
            for k, text in pdf[["key", "text"]].itertuples(index=False, name=None):
                score, answered = held.score(text)
                how = "program" if answered else "none"
                if not answered and fallback is not None:
                    score, how = fallback(text), "fallback"
                out.append((k, score, how))
            yield pd.DataFrame(out, columns=["key", "score", "scored_by"])

    from .snapshots import cut

    # Written once: a text is not asked again when the result is read twice.
    asked = cut(wanted.join(known, "key", "left_anti").mapInPandas(run, "key string, score double, scored_by string"))
    all_ = asked.unionByName(known.join(wanted, "key", "left_semi").withColumn("scored_by", F.lit("cache")))
    out = rows.withColumn("_key", key).join(all_.withColumnRenamed("key", "_key"), "_key", "left").drop("_key").withColumn("scored_by", F.coalesce("scored_by", F.lit("none")))
    return out, asked.where("scored_by = 'program'").select("key", F.lit(version).alias("version"), "score")
