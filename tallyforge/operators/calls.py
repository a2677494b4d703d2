"""Calls of an outside function, one row in and one row out, with retries and a log to go on from."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.utils import AnalysisException

from .logs import pending, success_and_residue

#: Takes a list of rows as dicts and gives for each its result, a dict, or an exception.
Call = Callable[[list[dict]], list]


def outcomes(call: Call, rows: list[dict], attempts: int, first_wait: float, longest_wait: float, sleep=time.sleep) -> list[tuple[dict | None, str | None, int]]:
    """(result, error, attempts made) of each row; only rows that failed are called again.

    The wait doubles from ``first_wait`` up to ``longest_wait``. An exception that the call
    raises, or a wrong number of answers, is the error of all the rows that it was given.
    """
    out: list = [None] * len(rows)
    left = list(range(len(rows)))
    for attempt in range(1, attempts + 1):
        try:
            answers = list(call([rows[k] for k in left]))
            if len(answers) != len(left):
                raise ValueError(f"{len(answers)} answers to {len(left)} rows")
        except Exception as error:  # noqa: BLE001  whatever the callable raises belongs into the error column
            answers = [error] * len(left)
        for k, answer in zip(left, answers):
            failed = isinstance(answer, BaseException)
            out[k] = (None, f"{type(answer).__name__}: {answer}", attempt) if failed else (answer, None, attempt)
        left = [k for k in left if out[k][1] is not None]
        if not left:
            break
        if attempt < attempts:
            sleep(min(longest_wait, first_wait * 2 ** (attempt - 1)))
    return out


def answered(requests: DataFrame, call: Call, result: str, attempts: int = 3, first_wait: float = 1.0, longest_wait: float = 30.0) -> DataFrame:
    """``requests`` with ``result`` (a struct of the type ``result``), ``error`` and ``attempts``.

    Every row comes back once: with a result, or with the text of its last error. Rows reach
    the callable in the batches of ``spark.sql.execution.arrow.maxRecordsPerBatch``. The
    plan calls again whenever it is run again, see ``answer_pending``.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("result", T._parse_datatype_string(result)), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = outcomes(call, batch.to_pylist(), attempts, first_wait, longest_wait) if batch.num_rows else []
            columns = [pa.array([f[k] for f in found], kind.field(len(batch.columns) + k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=kind.names)

    return requests.mapInArrow(run, schema)


def read_answers(spark: SparkSession, log: str, key: list[str]) -> DataFrame | None:
    """One row a key of a log: its last result, else its last error; None where there is no log."""
    try:
        rows = spark.read.option("basePath", log).parquet(log)
    except AnalysisException:
        return None
    return success_and_residue(rows, key, "run", F.col("error").isNull()).drop("succeeded")


def answer_pending(requests: DataFrame, key: list[str], log: str, call: Call, result: str, rounds: int = 1, **waits) -> DataFrame:
    """Call for the rows of ``requests`` without a result in ``log``, append, and return all keys' last rows.

    The rows are taken in ``rounds`` by a hash of the key; each is appended when it is done,
    so a job that fails loses the round that it was in. A key that has a result is never
    called again. ``log`` is a folder that driver and executors share.
    """
    spark = requests.sparkSession
    for k in range(rounds):
        todo = requests.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == k)
        done = read_answers(spark, log, key)
        if done is not None:
            todo = pending(todo, done, key, F.col("error").isNull())
        answered(todo, call, result, **waits).write.mode("errorifexists").parquet(f"{log}/run={time.time_ns()}")
    return read_answers(spark, log, key)
