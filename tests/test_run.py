import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ionloom import tools
from ionloom.functions import columns as C
from ionloom.run import open_run
from ionloom.sources import sinks
from ionloom.sources.manifest import ARCHIVE_SUFFIX, VERSION, Manifest, RunError
from runs import write_run, zipped

FILLED = {0: [100.0, 100.5, 101.0, 101.5, 102.0], 3: [99.75, 100.0, 100.25, 100.5, 100.75, 101.0]}


def arrays(run):
    return {r.spectrum_index: (list(r.mz), list(r.intensity)) for r in run.spectra().collect()}


EXPECTED = {0: (FILLED[0], [1, 2, 0, 4, 5]), 1: ([120.0, 150.0], [8, 7]), 2: ([150.25], [9]), 3: (FILLED[3], [0, 1, 0, 0, 2, 0]), 4: ([], []), 5: ([200.0, 300.0, 400.0], [1, 1, 1])}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    about = {"run": json.dumps({"id": "r", "start_time": "t"}), "software_list": json.dumps([{"id": "s", "version": "1", "parameters": [{"name": " ", "value": 1}, {"name": "tool", "value": True}]}]), "sample_list": "{}", "file_description": " "}
    return write_run(str(tmp_path_factory.mktemp("runs") / "point"), footer=about)


@pytest.mark.parametrize("layout", ["point", "chunk"])
@pytest.mark.parametrize("container", ["dir", "zip", "deflated"])
def test_layouts_and_containers_agree(spark, tmp_path, layout, container):
    path = write_run(str(tmp_path / "run"), layout=layout)
    if container != "dir":
        path = zipped(path, str(tmp_path / "run.zip"), zipfile.ZIP_STORED if container == "zip" else zipfile.ZIP_DEFLATED)
    with open_run(spark, path) as run:
        got = arrays(run)
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in EXPECTED.items()}
        for i, (mz, _) in EXPECTED.items():
            assert got[i][0] == pytest.approx(mz)


def test_gaps_can_be_dropped(spark, folder):
    with open_run(spark, folder, reconstruct=False) as run:
        got = arrays(run)
    assert got[0] == ([100.0, 100.5, 101.5, 102.0], [1, 2, 4, 5]) and got[3] == ([100.0, 100.75], [1, 2])


def test_metadata(spark, folder):
    rows = {r.spectrum_index: r for r in open_run(spark, folder).metadata().collect()}
    assert len(rows) == 6 and rows[4].rt is None and rows[0].polarity == "POSITIVE" and rows[1].continuity == "CENTROID"
    assert rows[2].scans[0].filter_string == "f2" and len(rows[1].scans[0].windows) == 0 and rows[0].scans[0].windows[0].upper == 500
    assert {p.accession: p.value.float or p.value.integer for p in rows[3].scans[0].params} == {"MS:1002476": 1.5, "IMS:1000050": 3, "IMS:1000051": 1}
    assert rows[5].precursors[0].ions[0].charge == 3 and rows[1].precursors[0].ions[0].charge is None
    assert rows[2].precursors[0].precursor is None and rows[2].precursors[0].ions[0].mz == 170
    assert rows[4].precursors[0].ions == [] and rows[0].precursors == []


def test_lookups(spark, folder):
    run = open_run(spark, folder)
    one = lambda **k: [r.spectrum_index for r in run.spectra(**k).collect()]
    assert one(index=3) == [3] and one(ordinal=2) == [2] and one(ordinal=99) == [] and one(scan=5) == [4]
    assert one(native_id="controllerType=0 controllerNumber=1 scan=1") == [0] and one(nearest_time=0.24) == [1] and one(nearest_time=9) == [5]
    assert run.contains(5) and not run.contains(6) and run.size() == 6


def test_other_tables(spark, folder):
    run = open_run(spark, folder)
    chromatograms = {r.chromatogram_index: r for r in run.chromatograms().collect()}
    assert chromatograms[0].intensity == [0, 1, 2] and chromatograms[1].time == []
    uv = run.wavelength_spectra().first()
    assert uv.lambda_max == 254 and uv.wavelength == [210, 211, 212] and uv.intensity == [0, -0.5, -1]
    s = run.scan_settings().first()
    assert (s.max_x, s.max_y, s.pixel_x) == (12, None, 2.5) and run.is_imaging
    about = run.file_metadata()
    assert about["run"]["start_time"] == "t" and about["sample_list"] == [] and about["file_description"] is None
    assert about["software_list"][0]["parameters"][1]["value"]["boolean"] is True


def test_xic_and_report(spark, folder):
    run = open_run(spark, folder)
    assert {r.spectrum_index: r.intensity for r in run.xic(100.25, C.da(0.3)).collect()} == {0: 3.0, 3: 1.0}
    report = run.report()
    assert {r.charge: r.spectra for r in report["charges"].collect()} == {"unknown": 2, "charge 1": 1, "charge 3": 1}
    assert {r.method: r.spectra for r in report["activation"].collect()} == {"CID": 2}
    total = report["ranges"].filter("ms_level is null").first()
    assert total.points == 17 and total.mz_max == 400 and total.spectra == 6


def test_validate(spark, folder, tmp_path):
    open_run(spark, folder).validate()
    import pyarrow.parquet as pq

    bad = write_run(str(tmp_path / "bad"))
    t = pq.read_table(f"{bad}/d.parquet")
    pq.write_table(t.take([0, 6, 1, 2, 3, 4, 5, 7]), f"{bad}/d.parquet")
    with pytest.raises(RunError):
        open_run(spark, bad).validate()


@pytest.mark.parametrize("layout,intensity", [("point", "slof"), ("numpress", "slof"), ("numpress", "pic")])
@pytest.mark.parametrize("container", ["dir", "zip"])
def test_write_and_reopen(spark, folder, tmp_path, layout, intensity, container):
    run = open_run(spark, folder)
    path = str(tmp_path / "out")
    sinks.write_run(run.metadata(), run.points(), path, run.chromatograms(), container, layout, intensity, run.file_metadata())
    again = open_run(spark, path)
    got = arrays(again)
    for i, (mz, values) in EXPECTED.items():
        order = sorted(range(len(mz)), key=lambda k: mz[k])
        written = got[i] if layout == "point" or i not in (1,) else tuple(map(list, zip(*sorted(zip(*got[i])))))
        assert written[0] == pytest.approx([mz[k] for k in order], abs=1e-5) and written[1] == pytest.approx([values[k] for k in order], rel=1e-3, abs=1e-3)
    assert {r.chromatogram_index: r.intensity for r in again.chromatograms().collect()} == {0: [0, 1, 2], 1: []}
    assert again.file_metadata()["run"]["id"] == "r" and again.manifest.version == VERSION
    assert {r.spectrum_index: len(r.precursors) for r in again.metadata().collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1}


def test_writing_to_a_store_that_only_spark_opens(spark, folder, tmp_path):
    """By a scheme that Python knows nothing of; a write that fails leaves nothing."""
    (tmp_path / "disk").mkdir()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./data", f"file://{tmp_path}/disk")
    run = open_run(spark, folder)
    sinks.write_run(run.metadata(), run.points(), "viewfs://lake/data/out", run.chromatograms(), about=run.file_metadata())
    again = open_run(spark, "viewfs://lake/data/out")
    assert {i: v for i, (_, v) in arrays(again).items()} == {i: v for i, (_, v) in EXPECTED.items()} and again.file_metadata()["run"]["id"] == "r"
    assert not [f.name for f in (tmp_path / "disk/out").iterdir() if f.name.startswith("_")]
    broken = run.points().withColumn("mz", F.when(F.col("spectrum_index") < 5, F.col("mz")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(run.metadata(), broken, "viewfs://lake/data/half")
    assert not (tmp_path / "disk/half").exists()
    with pytest.raises(RunError, match="mounted"):
        sinks.write_run(run.metadata(), run.points(), "viewfs://lake/data/x", container="zip")


def test_tools(spark, folder, tmp_path):
    run = open_run(spark, folder)
    tools.extract(run, str(tmp_path / f"ms1{ARCHIVE_SUFFIX}"), levels=[1])
    assert sorted(r.spectrum_index for r in open_run(spark, str(tmp_path / f"ms1{ARCHIVE_SUFFIX}")).metadata().collect()) == [0, 3]
    tools.to_dta(run, str(tmp_path / "dta"))
    assert (tmp_path / "dta/point.6.6.3.dta").read_text() == "447.98545 3\n200.00000 1.0000\n300.00000 1.0000\n400.00000 1.0000\n"
    with pytest.raises(RunError, match="empty"):
        tools.to_dta(run, str(tmp_path / "dta"))
    texts = {r.name: r.value for r in sinks.dta_texts(run.spectra(), "point.x").collect()}
    assert texts["point.6.6.3.dta"] == "447.98545 3\n200.00000 1.0000\n300.00000 1.0000\n400.00000 1.0000" and set(texts) == {"point.2.2.2.dta", "point.3.3.1.dta", "point.6.6.3.dta"}
    tools.to_xic_csv(run, str(tmp_path / "xic"), 100.25, C.da(0.3))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "xic")).collect()] == [("0.100000", "3.0000"), ("0.400000", "1.0000")]
    assert tools.info(run)["first"].count() == 5


def many_groups(folder, unsigned=True, sort=True, spectra=40, points=25, start=0):
    """Profile spectra whose m/z go up from 100 * (1 + index % 4), a null in the middle of every third; four rows a group."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    signals = {i: (1, i / 10, [None if i % 3 == 0 and k == 12 else 100.0 * (1 + i % 4) + k for k in range(points)], [float(k) for k in range(points)]) for i in range(start, start + spectra)}
    write_run(folder, signals)
    if not (unsigned and sort):
        t = pq.read_table(f"{folder}/d.parquet").column("point").combine_chunks()
        keys = t.field("spectrum_index").to_pylist()
        order = range(len(keys)) if sort else sorted(range(len(keys)), key=lambda i: (keys[i] * 7 % 11, keys[i], i))
        kind = pa.uint64() if unsigned else pa.int64()
        columns = [pa.array([keys[i] for i in order], kind), t.field("mz").take(pa.array(order)), t.field("intensity").take(pa.array(order))]
        pq.write_table(pa.table({"point": pa.StructArray.from_arrays(columns, names=["spectrum_index", "mz", "intensity"])}), f"{folder}/d.parquet", row_group_size=4)
    filled = {i: [100.0 * (1 + i % 4) + k for k in range(points)] for i in signals}
    return filled


@pytest.mark.parametrize("unsigned,sort,container", [(True, True, "dir"), (False, True, "zip"), (True, False, "zip")])
def test_only_needed_groups_are_read(spark, tmp_path, unsigned, sort, container):
    from ionloom.sources import manifest as M

    path = str(tmp_path / "run")
    filled = many_groups(path, unsigned, sort)
    if container == "zip":
        path = zipped(path, str(tmp_path / "run.zip"))
    with open_run(spark, path) as run:
        assert not run.place.staged
        total = run.member(M.SIGNALS).count()
        assert [list(r.mz) for r in run.spectra(index=18).collect()] == [filled[18]]
        assert run.needed(M.SIGNALS, (18, 18)).count() <= (25 + 2 * 3 if sort else 0.2 * total) and total == 1000
        if not sort:
            return
        assert [list(r.mz) for r in run.spectra(nearest_time=1.71).collect()] == [filled[17]]
        assert run.spectra(native_id="none").count() == 0 and run.needed(M.SIGNALS, (99, 99)).count() == 0
        # Gaps inside the window are filled as in a full read, at the edges of groups, too.
        for lo, hi in ((211.5, 212.5), (99, 101)):
            want = {i: sum(float(k) for k, m in enumerate(mz) if lo <= m <= hi) for i, mz in filled.items()}
            got = {r.spectrum_index: r.intensity for r in run.xic((lo + hi) / 2, C.da((hi - lo) / 2)).collect()}
            assert got == pytest.approx(want)
        read = run.needed(M.SIGNALS, None, (211.5, 212.5)).count()
        assert read < 0.45 * total
        late = run.xic(212, C.da(0.5), rt_min=3.0).collect()
        assert {r.spectrum_index for r in late} == set(range(30, 40)) and sum(r.intensity for r in late) == 12.0 * 2
        assert run.needed(M.SIGNALS, (30, 39)).count() <= 10 * 25 + 2 * 3


def test_groups_of_an_index(spark, tmp_path):
    from ionloom.sources.groups import Group, Member, for_keys, for_mz, group_index, read_groups

    many_groups(str(tmp_path / "run"))
    member = Member(str(tmp_path / "run/d.parquet"))
    index = group_index(member)
    assert sum(g.rows for g in index) == 1000 and [g.first_row for g in index] == list(range(0, 1000, 4))
    rows = read_groups(spark, member)
    assert rows.filter("point.spectrum_index = 7").count() == 25 and rows.count() == 1000  # a filter doesn't stay with the table
    few = for_keys(index, 7, 8)
    assert read_groups(spark, member, few).count() == sum(g.rows for g in few) <= 56
    g = lambda n, low, high, nulls, rows=4, keys=(0, 9): Group(n, 4 * n, rows, 1, keys, (low, high), nulls)
    told = lambda groups, low, high: [x.number for x in for_mz(groups, low, high)]
    assert told([g(0, 1, 2, 0), g(1, 3, 4, 0), g(2, 5, 6, 0)], 3.5, 3.6) == [1]
    assert told([g(0, 1, 2, 0), g(1, 3, 4, 1), g(2, 5, 6, 0), g(3, 7, 8, 0)], 90, 91) == [0, 1, 2]  # gaps need their neighbours
    assert told([g(0, 1, 2, 0), g(1, None, None, 4), g(2, None, None, 4), g(3, 5, 6, 0), g(4, 7, 8, 0)], 90, 91) == [0, 1, 2, 3]
    assert told([g(0, None, None, None), g(1, 5, 6, 0), g(2, 7, 8, 0)], 90, 91) == [0, 1]  # no statistics: always
    assert [x.number for x in for_keys([g(0, 1, 2, 0, keys=(None, None)), g(1, 1, 2, 0, keys=(5, 6))], 1, 2)] == [0]


def test_a_key_beyond_bigint_is_an_error(spark, tmp_path):
    from ionloom.sources import manifest as M

    many_groups(str(tmp_path / "run"), spectra=3)
    import pyarrow as pa
    import pyarrow.parquet as pq

    big = pa.StructArray.from_arrays([pa.array([2**63 + 5], pa.uint64()), pa.array([1.0]), pa.array([1.0], pa.float32())], names=["spectrum_index", "mz", "intensity"])
    pq.write_table(pa.table({"point": big}), f"{tmp_path}/run/d.parquet")
    run = open_run(spark, zipped(str(tmp_path / "run"), str(tmp_path / "run.zip")))
    with pytest.raises(Exception, match="out of bounds|not in range"):
        run.member(M.SIGNALS).collect()


def test_archives_are_read_in_place(spark, folder, tmp_path):
    import os
    from ionloom.sources.storage import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    path = zipped(folder, str(tmp_path / "run.zip"))
    with open_run(spark, path) as run:
        assert arrays(run)[3][0] == pytest.approx(FILLED[3]) and run.file_metadata()["run"]["start_time"] == "t"
        assert set(os.listdir(root)) == before and run.member(("spectrum", "peaks")).count() == 6
    broken = bytearray((tmp_path / "run.zip").read_bytes())
    at = zipfile.ZipFile(path).getinfo("d.parquet").header_offset
    broken[at : at + 2] = b"XX"
    (tmp_path / "broken.zip").write_bytes(bytes(broken))
    with pytest.raises(RunError):
        open_run(spark, str(tmp_path / "broken.zip"))


def test_command_line(spark, folder, tmp_path, capsys):
    from ionloom.__main__ import main

    assert main(["info", folder, "--first", "2"]) == 0
    assert "# levels" in (out := capsys.readouterr().out) and "# first" in out and out.count("controllerType=0") == 2
    assert main(["fileinfo", folder]) == 0
    assert "# ms1_intensity" in (out := capsys.readouterr().out) and '"start_time": "t"' in out
    assert main(["extract", folder, "--out", str(tmp_path / "late"), "--ms-level", "1,2", "--ms-level", "3", "--rt-min", "0.35", "--rt-max", "0.5"]) == 0
    assert sorted(r.spectrum_index for r in open_run(spark, str(tmp_path / "late")).metadata().collect()) == [3, 4]  # unknown times pass
    assert main(["dta", folder, "--out", str(tmp_path / "dta"), "--charge=3"]) == 0
    assert {p.name for p in (tmp_path / "dta").iterdir()} == {f"point.{n}.dta" for n in ("2.2.3", "3.3.1", "6.6.3")}
    assert main(["xic", folder, "--out", str(tmp_path / "xic"), "--mz", "100.25", "--da", "0.3"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "xic")).count() == 2
    with pytest.raises(SystemExit):
        main(["xic", folder, "--out", "x"])


def test_bad_archives(spark, folder, tmp_path):
    for extra in (["m.parquet"], ["../x"]):
        with pytest.raises(RunError):
            open_run(spark, zipped(folder, str(tmp_path / "bad.zip"), extra=extra))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    for path in ("none.zip", "missing"):
        with pytest.raises(RunError):
            open_run(spark, str(tmp_path / path))
    (tmp_path / "empty").mkdir()
    with pytest.raises(RunError):
        open_run(spark, str(tmp_path / "empty"))
    for text in ("{", "[]", '{"files": 1}'):
        with pytest.raises(RunError):
            Manifest.parse(text)


def test_store_prunes(spark, folder, tmp_path):
    open_run(spark, folder).store(str(tmp_path / "store"))
    p = spark.read.parquet(str(tmp_path / "store/profile"))
    assert p.schema["spectrum_index"].dataType.simpleString() == "bigint" and p.count() == 11
    assert [r.mz for r in p.filter("spectrum_index = 3").orderBy("ordinal").collect()] == FILLED[3]


def test_chunk_errors(spark):
    from ionloom.operators import chunks

    bad = spark.createDataFrame([(0, 0, 1.0, [1.0], "d", [1.0, 2.0, 3.0])], "spectrum_index long, chunk_no long, mz_chunk_start double, mz_chunk_values array<double>, chunk_encoding string, intensity array<double>")
    with pytest.raises(Exception, match="don't fit"):
        chunks.delta_points(bad).collect()
    none = chunks.delta_points(bad.limit(0))
    assert none.filter(F.lit(True)).count() == 0



def test_members_sorted_and_written_in_parts(spark, folder, tmp_path, monkeypatch):
    """More rows than a task should sort are written by ranges; the one file of each member holds the parts in order."""
    import pyarrow.parquet as pq

    run = open_run(spark, folder)
    metadata, points, chromatograms = run.metadata().cache(), run.points().cache(), run.chromatograms().cache()
    monkeypatch.setattr("ionloom.sources.storage.ROWS_A_TASK", 2)
    for layout, container in (("point", "dir"), ("numpress", "zip")):
        path = str(tmp_path / layout)
        sinks.write_run(metadata, points, path, chromatograms, container, layout, "pic", run.file_metadata())
        again = open_run(spark, path)
        got = arrays(again)
        assert {i: len(mz) for i, (mz, _) in got.items()} == {i: len(mz) for i, (mz, _) in EXPECTED.items()}
        for i, (mz, _) in EXPECTED.items():
            assert sorted(got[i][0]) == pytest.approx(sorted(mz), abs=1e-5)
        assert {r.chromatogram_index: r.intensity for r in again.chromatograms().collect()} == {0: [0, 1, 2], 1: []}
        assert again.size() == 6 and again.file_metadata()["run"]["id"] == "r"
        again.validate()
    f = pq.ParquetFile(tmp_path / "point" / "spectra_data.parquet")
    keys = [p["spectrum_index"] for p in f.read().column("point").to_pylist()]
    assert f.num_row_groups > 1 and keys == sorted(keys)


def test_a_footer_lists_a_bounded_number_of_column_chunks(spark, tmp_path):
    """Row groups are as small as asked until a member would have too many of them; every row is there, in order."""
    import pyarrow.parquet as pq

    store, (columns, most) = sinks.Store(spark, str(tmp_path)), (40, 1 << 14)
    wide = spark.range(100_000).select(F.col("id").alias("sort_key"), *[((F.col("id") + i) * 3.7).alias(f"c{i}") for i in range(columns)])
    sinks.write_member(wide, store, "large.parquet", ["sort_key"], 1 << 12)
    sinks.write_member(wide.limit(1000), store, "small.parquet", ["sort_key"], 1 << 12)
    large, small = pq.ParquetFile(tmp_path / "large.parquet"), pq.ParquetFile(tmp_path / "small.parquet")
    assert 100 < large.num_row_groups <= 1.5 * most / columns
    assert large.read(["c0"]).column("c0").to_pylist() == pytest.approx([i * 3.7 for i in range(100_000)])
    assert small.num_row_groups >= 5


def test_tables_of_a_run_meet_without_a_broadcast(spark, folder):
    """Spark guesses small parts of wide members to be small, whatever rows they have."""
    run = open_run(spark, folder)
    for df in (run.metadata(), run.metadata().select("spectrum_index", "rt"), run.points()):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
