"""Signals by row group: an index of groups from the footers, and a data source that reads the chosen groups where they are.

Keys are unsigned in the format. Spark reads such columns as decimals and can't prune by them, and it can't read Parquet
inside an archive. Here the footers' minima and maxima make an index, with an entry a group; the groups that a request may
need become partitions, and tasks read them from the file, or from the stored member's place inside the archive. Unsigned keys
come out as BIGINT. A group without statistics is read for every request.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "ionloom-groups"
#: Bytes of row groups that one task reads, if a group isn't larger by itself.
TASK_BYTES = 32 << 20
ROW_NO = pa.struct([("file", pa.string()), ("row", pa.int64())])
_UNBOUND = (None, None)


class Slice(io.RawIOBase):
    """A part of a file as a file of its own."""

    def __init__(self, path: str, start: int, size: int):
        self.file, self.start, self.size, self.at = open(path, "rb", buffering=0), start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0 if whence == io.SEEK_SET else self.at if whence == io.SEEK_CUR else self.size))
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        want = max(0, min(len(into), self.size - self.at))
        self.file.seek(self.start + self.at)
        got = self.file.readinto(memoryview(into)[:want])
        self.at += got
        return got

    def close(self) -> None:
        self.file.close()
        super().close()


@dataclass(frozen=True)
class Member:
    """Where a Parquet file is: a path that tasks can open, and the part of it that is the file, or all of it."""

    path: str
    start: int = 0
    size: int | None = None

    def open(self) -> pq.ParquetFile:
        return pq.ParquetFile(self.path if self.size is None else io.BufferedReader(Slice(self.path, self.start, self.size), 1 << 16))


@dataclass(frozen=True)
class Group:
    """A row group: its number and rows, and the ranges of its keys and m/z, None where the footer doesn't say."""

    number: int
    first_row: int
    rows: int
    bytes: int
    keys: tuple[int | None, int | None]
    mz: tuple[float | None, float | None]
    mz_nulls: int | None
    #: Values of the column that has most: rows, or what their lists hold.
    values: int = 0


def _range(columns: list, what: str) -> tuple:
    stats = [c.statistics for c in columns if c.path_in_schema.rsplit(".", 1)[-1] == what]
    return (stats[0].min, stats[0].max) if len(stats) == 1 and stats[0] is not None and stats[0].has_min_max else _UNBOUND


def _nulls(columns: list, what: str) -> int | None:
    stats = [c.statistics for c in columns if c.path_in_schema.rsplit(".", 1)[-1] == what]
    return stats[0].null_count if len(stats) == 1 and stats[0] is not None and stats[0].has_null_count else None


def group_index(member: Member, key: str = "spectrum_index") -> list[Group]:
    """The groups of a member in file order; reads its footer only."""
    with member.open() as f:
        about, out, row = f.metadata, [], 0
        for n in range(about.num_row_groups):
            g = about.row_group(n)
            columns = [g.column(i) for i in range(g.num_columns)]
            out.append(Group(n, row, g.num_rows, g.total_byte_size, _range(columns, key), _range(columns, "mz"), _nulls(columns, "mz"), max((c.num_values for c in columns), default=0)))
            row += g.num_rows
    return out


def _meets(have: tuple, low, high) -> bool:
    return have[0] is None or ((low is None or have[1] >= low) and (high is None or have[0] <= high))


def for_keys(groups: list[Group], low: int | None, high: int | None) -> list[Group]:
    """The groups that may hold a key in the range, both ends inclusive."""
    return [g for g in groups if _meets(g.keys, low, high)]


def for_mz(groups: list[Group], low: float, high: float) -> list[Group]:
    """The groups from which all points with an m/z in the range follow, filled gaps included.

    A group whose m/z lie outside and that has no gaps isn't needed. One with gaps, or without statistics, may give points
    inside, and needs the nearest known m/z on either side: the groups next to it as far as the first that has one. A gap is a
    null; an m/z that is no number isn't counted in footers and passes for a known one here.
    """
    known = [g.mz_nulls is not None and (g.mz[0] is not None or g.mz_nulls == g.rows) for g in groups]
    open_ends = {i for i, g in enumerate(groups) if not known[i] or g.mz_nulls}
    keep = open_ends | {i for i, g in enumerate(groups) if _meets(g.mz, low, high)}
    for i in open_ends:
        for step in (-1, 1):
            j = i + step  # another open end goes on by itself
            if 0 <= j < len(groups) and groups[j].number == groups[i].number + step and j not in open_ends:
                keep.add(j)
    return [groups[i] for i in sorted(keep)]


def signed(kind: pa.DataType) -> pa.DataType:
    """An Arrow type with signed keys and plain lists and strings, as Spark has them."""
    if pa.types.is_unsigned_integer(kind):
        return {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64()}[kind]
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, signed(f.type)) for f in kind])
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(pa.field("element", signed(kind.value_type)))
    if pa.types.is_large_string(kind):
        return pa.string()
    if pa.types.is_dictionary(kind):
        return signed(kind.value_type)
    return pa.float32() if pa.types.is_float16(kind) else pa.binary() if pa.types.is_large_binary(kind) else kind


def _schema(member: Member) -> pa.Schema:
    with member.open() as f:
        return pa.schema([pa.field(x.name, signed(x.type)) for x in f.schema_arrow] + [pa.field("row_no", ROW_NO)])


@dataclass
class GroupPartition(InputPartition):
    """Consecutive groups that one task reads: (number, first row) of each."""

    groups: list

    def __init__(self, groups: list):
        self.groups = groups


class GroupReader(DataSourceReader):
    def __init__(self, options: dict):
        self.member, self.groups = Member(**json.loads(options["member"])), json.loads(options["groups"])

    def partitions(self) -> list[InputPartition]:
        out, held = [], 0
        for g in self.groups:
            if not out or held + g["bytes"] > TASK_BYTES:
                out.append(GroupPartition([]))
                held = 0
            out[-1].groups.append((g["number"], g["first_row"]))
            held += g["bytes"]
        return out or [GroupPartition([])]

    def read(self, partition: GroupPartition) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        schema = _schema(self.member)
        file = self.member.path if self.member.size is None else f"{self.member.path}@{self.member.start}"
        with self.member.open() as f:
            for number, row in partition.groups:
                for batch in f.iter_batches(row_groups=[number], batch_size=65_536):
                    columns = [c.cast(schema.field(i).type) for i, c in enumerate(batch.columns)]
                    n = batch.num_rows
                    place = pa.StructArray.from_arrays([pa.repeat(file, n), pa.array(range(row, row + n), pa.int64())], fields=list(ROW_NO))
                    row += n
                    yield pa.RecordBatch.from_arrays([*columns, place], schema=schema)


class GroupSource(DataSource):
    """spark.read.format("ionloom-groups"): options member and groups as JSON, as read_groups() gives them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return from_arrow_schema(_schema(Member(**json.loads(self.options["member"]))))

    def reader(self, schema: StructType) -> DataSourceReader:
        return GroupReader(self.options)


def read_groups(spark: SparkSession, member: Member, groups: list[Group] | None = None, key: str = "spectrum_index") -> DataFrame:
    """The rows of a member's groups (all, if none are named), with row_no, their place in the file.

    Groups are chosen here and not by filters that Spark pushes down: those stay with the relation, so that another query of
    the same table would miss rows (Spark 4.1).
    """
    spark.dataSource.register(GroupSource)
    chosen = group_index(member, key) if groups is None else groups
    options = {"member": json.dumps(asdict(member)), "groups": json.dumps([{"number": g.number, "first_row": g.first_row, "bytes": g.bytes} for g in chosen])}
    return spark.read.format(FORMAT).options(**options).load()
