"""Small runs written with pyarrow, so that unsigned keys, large lists, ZSTD and footers are real."""

import json
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq

from ionloom.sources.manifest import MANIFEST

PARAM = pa.struct([("value", pa.struct([("integer", pa.int64()), ("float", pa.float64()), ("string", pa.string()), ("boolean", pa.bool_())])), ("accession", pa.string()), ("name", pa.string()), ("unit", pa.string())])
SPECTRUM = pa.struct([("index", pa.uint64()), ("id", pa.large_string()), ("MS_1000511_ms_level", pa.uint8()), ("time", pa.float32()), ("MS_1000465_scan_polarity", pa.int8()), ("MS_1000525_spectrum_representation", pa.string()), ("mz_delta_model", pa.large_list(pa.float64())), ("parameters", pa.large_list(PARAM))])
WINDOW = pa.struct([("MS_1000501_scan_window_lower_limit_unit_MS_1000040", pa.float64()), ("MS_1000500_scan_window_upper_limit_unit_MS_1000040", pa.float64())])
SCAN = pa.struct([("source_index", pa.uint64()), ("MS_1000016_scan_start_time_unit_UO_0000031", pa.float64()), ("MS_1000512_filter_string", pa.string()), ("scan_windows", pa.list_(WINDOW)), ("ion_mobility_value", pa.float64()), ("ion_mobility_type", pa.string()), ("IMS_1000050_position_x", pa.int32()), ("IMS_1000051_position_y", pa.int32()), ("parameters", pa.list_(PARAM))])
ISOLATION = pa.struct([("MS_1000827_isolation_window_target_mz", pa.float64()), ("MS_1000828_isolation_window_lower_offset", pa.float64()), ("MS_1000829_isolation_window_upper_offset", pa.float64())])
PRECURSOR = pa.struct([("source_index", pa.uint64()), ("precursor_index", pa.uint64()), ("precursor_id", pa.string()), ("isolation_window", ISOLATION), ("activation", pa.struct([("parameters", pa.list_(PARAM))]))])
ION = pa.struct([("source_index", pa.uint64()), ("MS_1000744_selected_ion_mz_unit_MS_1000040", pa.float64()), ("MS_1000041_charge_state", pa.float64()), ("MS_1000042_intensity_unit_MS_1000131", pa.float32()), ("parameters", pa.list_(PARAM))])
POINT = pa.struct([("spectrum_index", pa.uint64()), ("mz", pa.float64()), ("intensity", pa.float32())])
CHUNK = pa.struct([("spectrum_index", pa.uint64()), ("mz_chunk_start", pa.float64()), ("mz_chunk_end", pa.float64()), ("mz_chunk_values", pa.list_(pa.float64())), ("chunk_encoding", pa.string()), ("intensity", pa.list_(pa.float32()))])


def number(accession, value=None, name="x"):
    return {"value": {"integer": None, "float": value, "string": None, "boolean": None}, "accession": accession, "name": name, "unit": None}


#: Spectrum -> (level, time, m/z with nulls, intensity).
SIGNALS = {
    0: (1, 0.1, [100.0, 100.5, None, 101.5, 102.0], [1, 2, 0, 4, 5]),
    1: (2, 0.2, [150.0, 120.0], [7, 8]),
    2: (2, 0.3, [150.25], [9]),
    3: (1, 0.4, [None, 100.0, None, None, 100.75, None], [0, 1, 0, 0, 2, 0]),
    4: (2, None, [], []),
    5: (2, 0.6, [200.0, 300.0, 400.0], [1, 1, 1]),
}
MODEL = {3: [0.25]}


def table(path, footer=None, **columns):
    """Columns of different lengths, padded with nulls: facets aren't aligned."""
    n = max(len(v) for v, _ in columns.values())
    t = pa.table({k: pa.array(list(v) + [None] * (n - len(v)), kind) for k, (v, kind) in columns.items()})
    if footer:
        t = t.replace_schema_metadata(footer)
    pq.write_table(t, path, compression="zstd", row_group_size=4)


def write_run(folder, signals=SIGNALS, layout="point", footer=None):
    os.makedirs(folder)
    meta = [{"index": i, "id": f"controllerType=0 controllerNumber=1 scan={i + 1}", "MS_1000511_ms_level": lv, "time": rt, "MS_1000465_scan_polarity": 1 if i % 2 == 0 else -1, "MS_1000525_spectrum_representation": "MS:1000128" if lv == 1 else "MS:1000127", "mz_delta_model": MODEL.get(i), "parameters": []} for i, (lv, rt, _, _) in signals.items()]
    scans = [{"source_index": i, "MS_1000016_scan_start_time_unit_UO_0000031": float(i), "MS_1000512_filter_string": f"f{i}", "scan_windows": [{"MS_1000501_scan_window_lower_limit_unit_MS_1000040": 50.0, "MS_1000500_scan_window_upper_limit_unit_MS_1000040": None if i == 1 else 500.0}], "ion_mobility_value": 0.5 * i, "ion_mobility_type": None, "IMS_1000050_position_x": i, "IMS_1000051_position_y": 1, "parameters": []} for i in reversed(signals)]
    scans.insert(2, {"source_index": None})
    scans.append({"source_index": 99, "MS_1000512_filter_string": "orphan"})
    precursors = [{"source_index": i, "precursor_index": 0, "precursor_id": "p", "isolation_window": {"MS_1000827_isolation_window_target_mz": 150.0, "MS_1000828_isolation_window_lower_offset": 1.0, "MS_1000829_isolation_window_upper_offset": 2.0}, "activation": {"parameters": [number("MS:1000133", name="CID"), number("MS:1000045", 35.0)]}} for i in (5, 1)]
    ions = [{"source_index": 5, "MS_1000744_selected_ion_mz_unit_MS_1000040": 150.0, "MS_1000041_charge_state": 3.0}, {"source_index": 1, "MS_1000744_selected_ion_mz_unit_MS_1000040": 160.0, "MS_1000041_charge_state": float("nan")}, {"source_index": 2, "MS_1000744_selected_ion_mz_unit_MS_1000040": 170.0, "MS_1000041_charge_state": 1.0}, {"source_index": 4, "MS_1000744_selected_ion_mz_unit_MS_1000040": None}]
    table(f"{folder}/m.parquet", footer, spectrum=(meta, SPECTRUM), scan=(scans, SCAN), precursor=(precursors, PRECURSOR), selected_ion=(ions, ION))
    for name, level in (("d", 1), ("p", 2)):
        some = {i: s for i, s in signals.items() if s[0] == level and s[2]}
        if layout == "point":
            table(f"{folder}/{name}.parquet", point=([{"spectrum_index": i, "mz": m, "intensity": v} for i, s in some.items() for m, v in zip(s[2], s[3])], POINT))
        else:
            rows = []
            for i, (_, _, mz, inten) in some.items():
                last, steps = 0.0, []
                for m in mz:
                    steps.append(None if m is None else m - last)
                    last = last if m is None else m
                if mz[0] is not None:
                    rows.append({"spectrum_index": i, "mz_chunk_start": mz[0], "mz_chunk_values": steps[1:], "chunk_encoding": "MS:1003089", "intensity": inten})
                else:
                    rows.append({"spectrum_index": i, "mz_chunk_start": 0.0, "mz_chunk_values": steps, "chunk_encoding": "MS:1003089", "intensity": inten})
            table(f"{folder}/{name}.parquet", chunk=(rows, CHUNK))
    chromatogram = pa.struct([("index", pa.uint64()), ("id", pa.string()), ("MS_1000626_chromatogram_type", pa.string())])
    table(f"{folder}/cm.parquet", chromatogram=([{"index": 0, "id": "TIC", "MS_1000626_chromatogram_type": "MS:1000235"}, {"index": 1, "id": "empty", "MS_1000626_chromatogram_type": None}], chromatogram))
    table(f"{folder}/cd.parquet", point=([{"chromatogram_index": 0, "time": 0.1 * k, "intensity": float(k)} for k in range(3)], pa.struct([("chromatogram_index", pa.uint64()), ("time", pa.float64()), ("intensity", pa.float64())])))
    table(f"{folder}/wm.parquet", spectrum=([{"index": 7, "id": "uv", "time": 1.0, "MS_1003812_lambda_max_unit_UO:0000018": 254.0}], pa.struct([("index", pa.uint64()), ("id", pa.string()), ("time", pa.float64()), ("MS_1003812_lambda_max_unit_UO:0000018", pa.float64())])))
    table(f"{folder}/wd.parquet", point=([{"wavelength_spectrum_index": 7, "wavelength": 210.0 + k, "intensity": -0.5 * k} for k in range(3)], pa.struct([("wavelength_spectrum_index", pa.uint64()), ("wavelength", pa.float64()), ("intensity", pa.float64())])))
    roles = [("d", "spectrum", "data arrays"), ("p", "spectrum", "peaks"), ("m", "spectrum", "metadata"), ("cm", "chromatogram", "metadata"), ("cd", "chromatogram", "data arrays"), ("wm", "wavelength spectrum", "metadata"), ("wd", "wavelength spectrum", "data arrays")]
    settings = [{"id": "s", "parameters": [{"name": "px", "accession": "IMS:1000042", "value": "12", "unit_accession": None}, {"name": "size", "accession": "IMS:1000046", "value": "2.5", "unit_accession": "UO:1"}]}]
    with open(f"{folder}/{MANIFEST}", "w") as f:
        json.dump({"files": [{"name": f"{n}.parquet", "entity_type": e, "data_kind": k} for n, e, k in roles], "metadata": {"version": "v", "scan_settings_list": settings}}, f)
    return folder


def zipped(folder, path, method=zipfile.ZIP_STORED, extra=()):
    with zipfile.ZipFile(path, "w", method) as z:
        for n in sorted(os.listdir(folder)):
            z.write(os.path.join(folder, n), n)
        for n in extra:
            z.writestr(n, b"x")
    return path
