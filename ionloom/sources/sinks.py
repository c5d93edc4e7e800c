"""Writing runs back: each member one Parquet file, as a folder or as an archive; peak lists and chromatograms as text.

Members are written by Spark and then take their names, in any file system that Spark writes to. The interchange format wants one file a
member: rows are sorted and written by ranges, in many tasks, and the parts' row groups are then copied behind each other as bytes.
Long tables for analysis go through Run.store(), which isn't bound by that.

What the format's writers have always left out is left out here too: activation parameters, scan windows, the reconstruction
model, and all but the first scan, precursor and ion. Index columns are signed.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import chunks
from . import manifest as M
from . import storage
from . import tables as T
from .archive import pack

#: Column chunks, about, that a member's footer lists; all that write or open the file hold its footer whole.
FOOTER_CHUNKS = 1 << 14
#: Bytes of row groups that nobody asked for smaller (Parquet's default).
GROUP_BYTES = 128 << 20


class Store:
    """A folder in any file system that Spark writes to, by Hadoop's client on the driver: names, small files, removal."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
        self.jvm = spark.sparkContext._jvm
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def take_parts(self, table: str, name: str) -> None:
        """The part files of the table in a folder, in the order of their names, become the one file of this name, and the folder goes.

        Row groups of several are copied as they are, without decoding, a block at a time.
        """
        found = sorted((f.getPath() for f in self.files.listStatus(self.path(table)) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
        part = found[0] if len(found) == 1 else self._joined(found, self.path(f"{table}/_joined"))
        self.remove(name)
        if not self.files.rename(part, self.path(name)):
            raise M.RunError(f"{name} could not be put in place")
        self.remove(table)

    def _joined(self, parts: list, target):
        parquet, conf = self.jvm.org.apache.parquet.hadoop, self.files.getConf()
        opened = lambda p: parquet.util.HadoopInputFile.fromPath(p, conf)
        first = parquet.ParquetFileReader.open(opened(parts[0]))
        about = first.getFileMetaData()
        first.close()
        create = getattr(parquet, "ParquetFileWriter$Mode").valueOf("CREATE")
        writer = parquet.ParquetFileWriter(parquet.util.HadoopOutputFile.fromPath(target, conf), about.getSchema(), create, 128 << 20, 0)
        try:
            writer.start()
            for p in parts:
                writer.appendFile(opened(p))
            writer.end(about.getKeyValueMetaData())
        finally:
            writer.close()
        return target

    def write_text(self, name: str, text: str) -> None:
        out = self.files.create(self.path(name), True)
        try:
            out.write(text.encode("utf-8"))
        finally:
            out.close()

    def remove(self, name: str) -> None:
        self.files.delete(self.path(name), True)

    def edit(self, name: str, change) -> None:
        """change(local path) on a copy of the file, which then takes its place."""
        with tempfile.TemporaryDirectory() as own:
            local = self.jvm.org.apache.hadoop.fs.Path(f"file://{own}/{name}")
            self.files.copyToLocalFile(False, self.path(name), local, True)
            change(f"{own}/{name}")
            self.remove(name)  # with its checksums, which don't fit any more
            self.files.copyFromLocalFile(False, True, local, self.path(name))


def leaves(kind: types.DataType) -> int:
    """How many Parquet columns hold a value of this type."""
    if isinstance(kind, types.StructType):
        return sum(leaves(f.dataType) for f in kind)
    if isinstance(kind, types.MapType):
        return leaves(kind.keyType) + leaves(kind.valueType)
    return leaves(kind.elementType) if isinstance(kind, types.ArrayType) else 1


def group_bytes(schema: types.StructType, rows: int, asked: int) -> int:
    """Bytes of a row group: as asked, or as many more as leave some FOOTER_CHUNKS column chunks in all, values taken as eight bytes each."""
    columns = leaves(schema)
    return max(asked, min(rows * 8 * columns * columns // FOOTER_CHUNKS, GROUP_BYTES))


def write_member(df: DataFrame, store: Store, name: str, order: list, row_group: int | None = None, rows: int | None = None) -> None:
    """df, sorted, as the one file of this name; until it is whole it has another.

    rows: about how many df has, else they are counted. Many are sorted and written by ranges, as parts that are then joined.
    row_group: bytes of a row group; groups are larger where the member would have too many for a footer (group_bytes).
    """
    part = f"_{name}-{uuid.uuid4().hex}"
    rows = df.count() if rows is None else rows
    n = -(-rows // storage.ROWS_A_TASK)
    out = (df.repartitionByRange(n, *order) if n > 1 else df.repartition(1)).sortWithinPartitions(*order).drop("sort_key")
    writer = out.write.option("compression", "zstd")
    try:
        (writer.option("parquet.block.size", group_bytes(out.schema, rows, row_group)) if row_group else writer).parquet(f"{store.folder}/{part}")
        store.take_parts(part, name)
    finally:
        store.remove(part)


def _with_footer(path: str, documents: dict[str, str]) -> None:
    """Adds key-value pairs to a local file's footer, row group by row group."""
    with pq.ParquetFile(path) as source:
        schema = source.schema_arrow.with_metadata({**(source.schema_arrow.metadata or {}), **{k.encode(): v.encode() for k, v in documents.items()}})
        with pq.ParquetWriter(f"{path}.new", schema, compression="zstd") as out:
            for i in range(source.num_row_groups):
                out.write_table(pa.Table.from_batches(source.read_row_group(i).to_batches(), schema=source.schema_arrow).cast(schema))
    os.replace(f"{path}.new", path)


def footer_documents(about: dict | None) -> dict[str, str]:
    """The documents that aren't empty, as JSON; a run without ids of its defaults gets ours."""
    if not about:
        return {}
    out = {k: about[k] for k in M.DOCUMENTS if about.get(k)}
    if "run" in out:
        run = dict(out["run"])
        run["default_data_processing_id"] = run.get("default_data_processing_id") or "ionloom-processing"
        run["default_source_file_id"] = run.get("default_source_file_id") or "ionloom-source"
        out["run"] = run
    plain = lambda x: _plain(x)
    return {k: json.dumps(plain(v), ensure_ascii=False) for k, v in out.items()}


def _plain(x):
    """Parameters with their one value instead of four arms."""
    if isinstance(x, list):
        return [_plain(i) for i in x]
    if isinstance(x, dict):
        if set(x) == {"name", "accession", "value", "unit"}:
            return {**x, "value": next((v for v in x["value"].values() if v is not None), None)}
        return {k: _plain(v) for k, v in x.items()}
    return x


def metadata_rows(metadata: DataFrame, counts: DataFrame) -> DataFrame:
    """The packed metadata member: one row a spectrum with all four structs; the number of points under its spectrum's continuity."""
    m = metadata.join(counts.hint("merge"), "spectrum_index", "left")
    centroid, n = F.col("continuity") == "CENTROID", F.coalesce("n", F.lit(0)).cast("bigint")
    scan, precursor = C.first_of("scans"), C.first_of("precursors")
    ion, index = C.first_of(precursor["ions"]), F.col("spectrum_index")
    own = lambda have, s: F.when(have.isNotNull(), s)
    code = F.when(F.col("polarity") == "POSITIVE", 1).when(F.col("polarity") == "NEGATIVE", -1)
    spectrum = F.struct(index.alias("index"), "id", F.col("ms_level").alias(T.LEVEL), C.finite("rt").alias("time"), code.alias(T.POLARITY), F.when(centroid, C.CENTROID).otherwise(C.PROFILE).alias(T.REPRESENTATION), F.when(~centroid, n).alias(T.N_POINTS), F.when(centroid, n).alias(T.N_PEAKS), F.col("params").alias("parameters"))
    scans = F.struct(index.alias("source_index"), scan["start_time"].alias(T.START_TIME), scan["injection_time"].alias(T.INJECTION), scan["filter_string"].alias(T.FILTER), scan["preset_scan_configuration"].alias(T.PRESET), scan["instrument_configuration_ref"].alias("instrument_configuration_ref"), scan["spectrum_reference"].alias("spectrum_reference"), scan["params"].alias("parameters"))
    p = precursor["precursor"]
    precursors = F.struct(index.alias("source_index"), p["precursor_index"].alias("precursor_index"), p["precursor_id"].alias("precursor_id"), F.struct(*[p["isolation_window"][a].alias(n) for n, a in zip(T.ISOLATION, ("target_mz", "lower_offset", "upper_offset"))]).alias("isolation_window"))
    ions = F.struct(index.alias("source_index"), ion["mz"].alias(T.ION_MZ), ion["charge"].alias(T.ION_CHARGE), ion["intensity"].alias(T.ION_INTENSITY), ion["params"].alias("parameters"))
    return m.select(index.alias("sort_key"), spectrum.alias("spectrum"), own(scan, scans).alias("scan"), own(precursor, precursors).alias("precursor"), own(ion, ions).alias("selected_ion"))


def write_run(metadata: DataFrame, points: DataFrame, path: str, chromatograms: DataFrame | None = None, container: str = "dir", layout: str = "point", intensity: str = "slof", about: dict | None = None, row_group: int | None = None) -> None:
    """Writes spectra (Run.metadata()), their payload points and chromatograms (with arrays) to a folder in any file system that Spark writes to, or to a local archive.

    Points of centroid spectra make the peaks member, all others the data member; a member without rows isn't written, but
    with the Numpress layout the data member always is, and holds all of them. The manifest comes last, and a write that fails
    takes back its members; an archive appears whole or not at all.
    """
    if container not in ("dir", "zip") or layout not in ("point", "numpress"):
        raise M.RunError("container is dir or zip, layout is point or numpress")
    if not metadata.filter("spectrum_index < 0").isEmpty():
        raise M.RunError("a spectrum has a negative index")
    if container == "zip" and "://" in path:
        raise M.RunError("archives are written to local or mounted paths; write a folder instead")
    spectra, size = metadata.count(), points.count()
    metadata, points = storage.dealt(metadata, max(spectra, size), "spectrum_index"), storage.dealt(points, max(spectra, size), "spectrum_index")
    store = Store(metadata.sparkSession, path if container == "dir" else f"{path}.{uuid.uuid4().hex}.members")
    new = store.files.mkdirs(store.path("")) and not store.files.listStatus(store.path(""))
    files: list[dict] = []
    try:
        files = [{"name": "spectra_metadata.parquet", "entity_type": "spectrum", "data_kind": "metadata"}]
        write_member(metadata_rows(metadata, points.groupBy("spectrum_index").agg(F.count("*").alias("n"))), store, files[0]["name"], ["sort_key"], row_group, spectra)
        documents = footer_documents(about)
        if documents:
            store.edit(files[0]["name"], lambda local: _with_footer(local, documents))

        def add(df: DataFrame, name: str, role: tuple[str, str], rows: int) -> None:
            files.append({"name": name, "entity_type": role[0], "data_kind": role[1]})
            write_member(df, store, name, ["sort_key"], row_group, rows)

        def point(df: DataFrame, index: str, axis: str) -> DataFrame:
            return df.select(F.struct(F.col(index), F.col(axis).cast("double").alias(axis), F.col("intensity").cast("double").alias("intensity")).alias("point"), F.struct(index, "ordinal").alias("sort_key"))

        if layout == "numpress":
            coded = chunks.numpress_chunks(points, ["ordinal"], intensity)
            row = coded.select(F.struct("spectrum_index", "mz_chunk_start", "mz_chunk_end", "chunk_encoding", _byte_list("mz_numpress_linear_bytes"), _byte_list(f"intensity_numpress_{intensity}_bytes")).alias("chunk"), F.struct("spectrum_index", "chunk_no").alias("sort_key"))
            add(row, "spectra_data.parquet", M.SIGNALS, size)
        else:
            kind = points.join(metadata.select("spectrum_index", (F.col("continuity") == "CENTROID").alias("centroid")).hint("merge"), "spectrum_index")
            for centroid, name, role in ((False, "spectra_data.parquet", M.SIGNALS), (True, "spectra_peaks.parquet", M.PEAKS)):
                some = kind.filter(F.col("centroid") if centroid else ~F.col("centroid"))
                if not some.isEmpty():
                    add(point(some, "spectrum_index", "mz"), name, role, size)
        traces, values = chromatograms.agg(F.count("*"), F.coalesce(F.sum(F.size("time")), F.lit(0))).first() if chromatograms is not None else (0, 0)
        if traces:
            meta = chromatograms.select(F.struct(F.col("chromatogram_index").alias("index"), "id", F.col("type").alias(T.CHROMATOGRAM_TYPE), F.size("time").cast("bigint").alias(T.N_POINTS)).alias("chromatogram"), F.col("chromatogram_index").alias("sort_key"))
            add(meta, "chromatograms_metadata.parquet", M.CHROMATOGRAMS, traces)
            rows = chromatograms.select("chromatogram_index", F.posexplode(F.arrays_zip("time", "intensity")).alias("ordinal", "z")).select("chromatogram_index", "ordinal", "z.*")
            add(point(rows, "chromatogram_index", "time"), "chromatograms_data.parquet", M.CHROMATOGRAM_SIGNALS, values)
        doc = {"files": files, "metadata": {"version": M.VERSION, "cv_list": list(M.VOCABULARIES), "scan_settings_list": [], **{k: json.loads(v) for k, v in documents.items()}}}
        store.write_text(M.MANIFEST, json.dumps(doc, indent=2, ensure_ascii=False))
        if container == "zip":
            pack(store.folder.removeprefix("file://"), path)
    except BaseException:
        for name in (f["name"] for f in files):
            store.remove(name)
        if new:
            store.remove("")
        raise
    finally:
        if container == "zip":
            store.remove("")


def byte_lists(column: pa.Array) -> pa.Array:
    """Binary as lists of byte values, by a view of the bytes; null for null."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values).cast(pa.int32()), mask=column.is_null())


def _byte_list(column: str) -> Column:
    """Binary as the format's list of byte values."""
    return F.arrow_udf(byte_lists, "array<int>")(column).alias(column)


def xic_lines(chromatogram: DataFrame) -> DataFrame:
    """An extracted-ion chromatogram's lines, (spectrum_index, value), to be written as text under the header retention_time,intensity."""
    return chromatogram.select("spectrum_index", F.format_string("%.6f,%.4f", "rt", "intensity").alias("value"))


def write_xic_csv(chromatogram: DataFrame, path: str) -> None:
    rows = chromatogram.select("spectrum_index", F.format_string("%.6f", "rt").alias("retention_time"), F.format_string("%.4f", "intensity").alias("intensity"))
    rows.orderBy("spectrum_index").drop("spectrum_index").write.option("header", True).csv(path)


def dta_texts(spectra: DataFrame, base: str, default_charge: int = 2, keep: Column | None = None) -> DataFrame:
    """(name, value): the text of each MSn spectrum that has an ion: mass and charge, then a line a peak; peaks before arrays.

    Named <base up to its first dot>.<scan>.<scan>.<charge>.dta; of spectra with one name the last by index stays.
    """
    ion = C.first_of(C.first_of("precursors")["ions"])
    rows = spectra.filter(C.is_msn("ms_level")).filter(F.lit(True) if keep is None else keep).withColumn("ion", ion).filter("ion is not null")
    charge = F.coalesce(F.col("ion.charge"), F.lit(default_charge))
    own = F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    pairs = F.when(F.size("peaks") > 0, own).otherwise(F.arrays_zip("mz", "intensity"))
    lines = F.transform(pairs, lambda p: F.format_string("%.5f %.4f", p["mz"], p["intensity"]))
    head = F.format_string("%.5f %d", C.mh_plus("ion.mz", "ion.charge", default_charge), charge)
    scan = F.coalesce(C.scan_number("id").cast("bigint"), F.col("spectrum_index")).cast("string")
    name = F.concat_ws(".", F.lit(base.split(".")[0]), scan, scan, charge.cast("string"), F.lit("dta"))
    texts = rows.select("spectrum_index", name.alias("name"), F.array_join(F.concat(F.array(head), lines), "\n").alias("value"))
    return texts.groupBy("name").agg(F.max_by("value", "spectrum_index").alias("value"))


def write_dta(texts: DataFrame, path: str) -> None:
    """A file for each text, under its name, in a new folder that the tasks can write to; each appears under its name when it is whole.

    In a store that only Spark writes to, a folder name=<name> for each text instead.
    """
    if "://" in path and not path.startswith("file:"):
        texts.write.partitionBy("name").text(path)
        return
    folder = os.path.abspath(path.removeprefix("file://"))
    os.makedirs(folder, exist_ok=True)
    if os.listdir(folder):
        raise M.RunError(f"{folder} isn't empty")

    def write(rows) -> None:
        for r in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
            with open(part, "w", encoding="utf-8") as f:
                f.write(r.value + "\n")
            os.replace(part, os.path.join(folder, r.name))

    texts.select("name", "value").foreachPartition(write)
