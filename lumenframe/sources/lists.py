"""Plain lists as tables, paths, and a log that also takes what is printed."""

from __future__ import annotations

import contextlib
import logging
import sys
import time
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str, columns: Sequence[str], comment: str = "#") -> DataFrame:
    """A text file of columns apart by white space; lines that begin with the comment sign and empty ones are left out, missing columns are null.

    ``columns`` are names with types, as in ``["name string", "wavelength double"]``; what does not fit a type is null.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith(comment)).select(F.split("line", " ").alias("part"))
    named = [c.split(None, 1) for c in columns]
    return kept.select(*(F.expr(f"try_cast(get(part, {k}) AS {kind})").alias(name) for k, (name, kind) in enumerate(named)))


def store_path(path: str | Path) -> str:
    """A store's path without an end slash; a local one made absolute, a URI left as it is."""
    text = str(path)
    if "://" in text or text.startswith("file:"):
        return text.rstrip("/")
    return str(Path(text).expanduser().resolve())


def exists(spark: SparkSession, path: str | Path) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store_path(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class _Lines:
    """A stream that hands whole lines to a logger."""

    def __init__(self, logger: logging.Logger, level: int):
        self.logger, self.level, self.rest = logger, level, ""

    def write(self, text: str) -> int:
        *lines, self.rest = (self.rest + text).split("\n")
        for line in lines:
            if line.strip():
                self.logger.log(self.level, line.rstrip())
        return len(text)

    def flush(self) -> None:
        if self.rest.strip():
            self.logger.log(self.level, self.rest.rstrip())
        self.rest = ""


@contextlib.contextmanager
def logged(folder: str | Path, name: str = "run", capture: bool = False) -> Iterator[logging.Logger]:
    """A logger that writes to a file named by the time; with ``capture`` it also takes what is printed meanwhile."""
    path = Path(folder) / f"{name}-{time.strftime('%Y%m%d-%H%M%S')}.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("lumenframe")
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    level = logger.level
    logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    out, err = _Lines(logger, logging.INFO), _Lines(logger, logging.WARNING)
    try:
        with contextlib.ExitStack() as stack:
            if capture:
                stack.enter_context(contextlib.redirect_stdout(out))
                stack.enter_context(contextlib.redirect_stderr(err))
            yield logger
    finally:
        out.flush()
        err.flush()
        logger.removeHandler(handler)
        logger.setLevel(level)
        handler.close()


def say(logger: logging.Logger | None, text: str) -> None:
    """To the log if there is one, else to the error stream."""
    if logger is not None:
        logger.info(text)
    else:
        print(text, file=sys.stderr)
