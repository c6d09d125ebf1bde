"""Text columns in, struct columns out: the Arrow UDF that the text operators share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Texts that are Python strings at one time in one task.
ROWS_AT_ONCE = 128

_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.float64()): "array<double>", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<bigint>"}


#: What clears the caches that operators keep in a worker, by operator.
_CLEAR: dict[str, Callable[[], None]] = {}


def held(operator: str, clear: Callable[[], None] | None = None) -> None:
    """Tells that the module `operator` works in this worker now, and how to clear what it keeps; what others keep is cleared.

    A worker serves one stage after the other; so it holds the vocabulary, automaton or
    memo of one operator at a time, not of all that it ever served.
    """
    for name in [n for n in _CLEAR if n != operator]:
        _CLEAR.pop(name)()
    if clear:
        _CLEAR[operator] = clear


def text_udf(make: Callable[[], Callable[[list[str]], list[tuple]]], **fields: pa.DataType):
    """A UDF from a string column to a struct of `fields`.

    `make` is called once a task and gives a function from a list of texts (null read as
    empty) to a list of rows. Only the text column and the small results cross to Python;
    all other columns stay in the JVM. The UDF is marked non-deterministic so that Spark
    evaluates it once however often its fields are used.
    """
    kind, names = pa.struct(list(fields.items())), list(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held(make.__module__)
        work = make()
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for at in range(0, len(batch), ROWS_AT_ONCE):
                texts = [x or "" for x in batch.slice(at, ROWS_AT_ONCE).to_pylist()]
                for row in work(texts):
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, type=kind.field(n).type) for n, c in zip(names, columns)], fields=list(kind))

    ddl = "struct<" + ",".join(f"{n}:{_DDL[t]}" for n, t in fields.items()) + ">"
    return F.arrow_udf(run, ddl).asNondeterministic()
