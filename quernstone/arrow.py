"""Arrow-batched Python kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quernstone.runtime import ship


SLICE = 256  # rows of a batch that are Python objects at once


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: StructType) -> DataFrame:
    """Rows of df through a Python kernel, in Arrow batches.

    make() runs once in each task and gives the kernel (compile patterns, open vocabularies there). The kernel takes
    the columns of one row and yields any number of output tuples. A batch is worked through in slices, each freed before the next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        out_schema = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                columns = [c.to_pylist() for c in batch.slice(start, SLICE).columns]
                rows: list[tuple] = []
                for row in zip(*columns):
                    rows.extend(kernel(*row))
                if rows:
                    cells = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(cells, out_schema)], schema=out_schema
                    )

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
