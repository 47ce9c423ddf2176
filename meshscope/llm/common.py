"""Helpers shared by the operators: row packing, word pattern, held-out split."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of the contracts: runs of anything but space and \t..\r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = "\t\n\x0b\x0c\r"


def words_of(text: str) -> list[str]:
    """The words of ``text``: split at space and \\t..\\r only, unlike ``str.split()``."""
    for c in _OTHER_SPACE:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def column(name: str) -> Column:
    """A column by its literal name (dots and other signs included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, *more: Column, name: str = "row") -> DataFrame:
    """All columns of ``df`` as one struct, so that new columns cannot clash with them."""
    return df.select(F.struct(*[column(c) for c in df.columns]).alias(name), *more)


def unpack(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(f"{name}.*")


def append(
    df: DataFrame,
    inputs: str | list[str],
    fields: T.StructType,
    fn: Callable[..., list],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """One output row per row: struct ``row`` (the ``keep`` columns, default all) and ``fields``.

    ``fn`` gets one Python list per input column for each Arrow batch and returns
    one list per field.  A task holds one batch at a time.
    """
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    keep = list(df.columns if keep is None else keep)
    need = list(dict.fromkeys(keep + inputs))
    source = df.select(*[column(c) for c in need])
    row = T.StructType([source.schema[c] for c in keep])
    out = T.StructType([T.StructField("row", row, False), *fields.fields])
    names = [f.name for f in fields.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields.fields]
        for batch in batches:
            made = fn(*[batch.column(need.index(c)).to_pylist() for c in inputs])
            kept = [batch.column(need.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.StructArray.from_arrays(kept, names=keep),
                    *[pa.array(v, type=k) for v, k in zip(made, kinds)],
                ],
                names=["row", *names],
            )

    return source.mapInArrow(run, out)


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5, is 0.  A null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Remembered(dict):
    """``make(key)`` for each key, remembered in two bounded generations.

    Forgetting a key only costs the time to make it again.
    """

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
