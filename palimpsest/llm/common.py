"""What several operators of this subpackage share: the word rule, block
processing over Arrow batches, and cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Fixed value: the white space that separates words, as a character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
BATCH_ROWS = 1000


def word_count(text: Column) -> Column:
    """Number of words of ``text`` as a long; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(
        F.length(F.coalesce(trimmed, F.lit(""))) == 0, F.lit(0)
    ).otherwise(F.size(F.split(trimmed, f"[{SPACE_CLASS}]+"))).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of one text as UTF-8 bytes (bytes.split uses the same six
    white-space characters as the word rule)."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that ``spark.checkpoint.dir`` names, so
    that later rounds neither recompute it nor depend on an executor's disk."""
    return materialize(df)


def sent(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of few numbers a row, to be sent to all tasks if it has
    ``most`` rows or fewer; otherwise joins shuffle both sides."""
    return F.broadcast(table) if table.count() <= most else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, after a session setting that lets no more than BATCH_ROWS rows go to
    Python at a time. Texts are long, and a batch is held on both sides, before and
    after it is worked on: the usual 10,000 rows take a good part of an executor."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def append_by_block(
    df: DataFrame,
    text: str,
    compute: Callable[[list], dict[str, list]],
    fields: T.StructType,
    block_chars: int = 4_000_000,
    at_end: Callable[[], None] | None = None,
) -> DataFrame:
    """Append ``fields`` to every row of ``df`` through ``compute``, a function
    from a block of texts to one list for each field.

    Arrow batches are cut into blocks of about ``block_chars`` characters, which
    bounds the memory of a task whatever the texts' lengths. There is no
    shuffle. Columns of ``df`` that bear a new field's name are replaced.
    ``at_end`` is called after the last block of a task.
    """
    clash = {f.name.lower() for f in fields} - {text.lower()}
    df = df.drop(*[c for c in df.columns if c.lower() in clash])
    names = [f.name for f in fields]
    schema = T.StructType(df.schema.fields + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for start, n in _cuts(column, block_chars):
                block = batch.slice(start, n)
                made = compute(column.slice(start, n).to_pylist())
                arrays = [_array(made[f.name], f.dataType) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    block.columns + arrays, names=block.schema.names + names
                )
        if at_end is not None:
            at_end()
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return short_batches(df).mapInArrow(run, schema)


# Spark's types and Arrow's.
_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
    "double": pa.float64(), "binary": pa.binary(),
}


def _array(values: list, kind: T.DataType) -> pa.Array:
    return pa.array(values, type=_ARROW[kind.simpleString()])


def _cuts(column: pa.Array, block_chars: int) -> Iterator[tuple[int, int]]:
    """(start, number of rows) of the blocks of a batch."""
    start, chars = 0, 0
    for i, value in enumerate(column):
        chars += len(value.as_buffer()) if value.is_valid else 0
        if chars >= block_chars:
            yield start, i + 1 - start
            start, chars = i + 1, 0
    if start < len(column):
        yield start, len(column) - start
