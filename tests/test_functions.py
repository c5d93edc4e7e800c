import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import codecs, peaks
from ionloom.functions import columns as C
from ionloom.operators import analytics, gaps, lookups

IDS = [("controllerType=0 controllerNumber=1 scan=3", 3), ("function=1 process=0 scan=42", 42), ("scanId=1", 1), ("frame=7 x=2", 7), ("sample=1 period=1 cycle=123 experiment=1", 123), ("index=99", 99), ("spectrum=5", 5), (None, None), ("scan=99999999999 frame=7", None), ("prescan=4", None)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scan_numbers(spark):
    df = spark.createDataFrame(IDS, "id string, scan int")
    assert [r.got for r in df.select(C.scan_number("id").alias("got")).collect()] == [s for _, s in IDS]


def param(accession, integer=None, number=None, text=None, name="n"):
    none = F.lit(None)
    value = F.struct((F.lit(integer) if integer is not None else none).cast("long").alias("integer"), (F.lit(number) if number is not None else none).cast("double").alias("float"), (F.lit(text) if text else none).cast("string").alias("string"), none.cast("boolean").alias("boolean"))
    return F.struct(F.lit(name).alias("name"), F.lit(accession).cast("string").alias("accession"), value.alias("value"), none.cast("string").alias("unit"))


def test_parameters(spark):
    params = F.array(param(None, 1), param("A", text="t"), param("A", 2), param("B", number=1.5))
    assert one(spark, C.param_double(C.find_param(params, "A"), 9)) == 9 and one(spark, C.param_double(C.find_param(params, "B"), 9)) == 1.5
    assert one(spark, C.has_param(params, "A")) and not one(spark, C.has_param(params, "C")) and one(spark, C.param_text(C.find_param(params, "A"))) == "t"
    assert one(spark, C.display_name(F.array(param("A", name=" "), param("B", name="tool")), F.lit("id"))) == "tool"


def test_activation(spark):
    both = F.array(param("MS:1000422", name="HCD"), param("MS:1000133", name="CID"), param("MS:1000045", number=35.0))
    assert one(spark, C.activation_summary(both)) == "HCD + CID @ 35.0 eV"
    assert one(spark, C.activation_summary(F.array(param("MS:1000045", number=float("nan"))))) == "custom"
    assert one(spark, C.activation_summary(F.lit(None).cast(f"array<{C.PARAM}>"))) == "(none)"


def test_ion_mobility(spark):
    params = F.array(param("MS:1002477", 3), param("MS:1002476", text="no"), param("MS:1003006", number=1.0))
    assert one(spark, C.ion_mobility_value(params)) == 3 and one(spark, C.ion_mobility_type(params)) == "MS:1002476"
    assert one(spark, C.ion_mobility_of_ion(F.array(param("MS:1003006", number=float("inf")), param("MS:1003156", number=2.0), param("MS:1002476", 1)))) == 2


def test_codes_and_tolerances(spark):
    assert [one(spark, C.component_type(F.lit(x))) for x in ("IonSource", "mass_analyzer", "detector", "?", None)] == ["ION_SOURCE", "ANALYZER", "DETECTOR", "UNKNOWN", "UNKNOWN"]
    assert one(spark, C.chromatogram_type_name(F.lit("MS:1000235"))) == "total ion current" and one(spark, C.chromatogram_type_name(F.lit("x"))) == "?"
    assert one(spark, C.ppm(10).test(F.lit(100.0009), F.lit(100.0))) and not one(spark, C.ppm(8).test(F.lit(100.0009), F.lit(100.0)))
    for bad in (-1, math.nan, math.inf):
        with pytest.raises(ValueError):
            C.da(bad)
    settings = F.array(param("IMS:1000042", text="x"), param("IMS:1000042", text="7"))
    assert one(spark, C.setting_number(settings, "IMS:1000042", "int")) == 7
    df = spark.createDataFrame([(1, 0.5), (2, None), (2, float("nan")), (None, 3.0)], "ms_level int, rt double")
    assert df.filter(C.spectrum_filter([2], 1, 2)).count() == 2 and df.filter(C.spectrum_filter(None, 1, 3)).count() == 3


def test_peak_search(spark):
    df = spark.createDataFrame([([3.0, float("nan"), 1.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0, 5.0])], "mz array<double>, i array<double>").select(peaks.normalised_peaks("mz", "i").alias("p"))
    assert [(x.mz, x["index"]) for x in df.first().p] == [(1, 2), (1, 4), (2, 3), (3, 0)]
    found = df.select(peaks.find_peak("p", 1.5, C.da(0.5)).alias("a"), peaks.find_peak("p", 9.0, C.da(1)).alias("b"), peaks.find_peaks("p", 2.0, C.da(1)).alias("c"), peaks.find_peaks_between("p", 3, 1).alias("d")).first()
    assert found.a.mz == 1 and found.a["index"] == 2 and found.b is None and len(found.c) == 4 and found.d == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_codecs(n):
    r = np.random.default_rng(n)
    v = np.cumsum(r.random(n) * 3) + 100
    assert codecs.decode(codecs.LINEAR, codecs.encode_linear(v, 1e5)) == pytest.approx(v, abs=6e-6)
    assert len(codecs.encode_linear(v, 1e5)) <= 8 + 5 * n
    counts = r.integers(0, 2**31 - 1, n)
    assert codecs.decode(codecs.PIC, codecs.encode_pic(counts)).tolist() == counts.tolist()
    s = r.random(n) * 1e6
    assert codecs.decode(codecs.SLOF, codecs.encode_slof(s, codecs.slof_fixed_point(s))) == pytest.approx(s, rel=2e-4, abs=1e-3)
    numbers = r.integers(-(2**31), 2**31, n)
    assert codecs.decode_pic_batch(*_rows([codecs.pack(numbers, np.array([len(numbers)]))[0].tobytes()]))[0].tolist() == numbers.tolist()


def test_codec_errors():
    for term, data in ((codecs.LINEAR, b"123"), (codecs.LINEAR, b"1" * 13), (codecs.PIC, b"\x01"), ("MS:1", b"")):
        with pytest.raises(ValueError):
            codecs.decode(term, data)


def test_gap_fill_against_loops(spark):
    r = random.Random(4)
    rows, models = [], {0: [0.5, 0.01], 1: [], 2: None, 3: [0.1]}
    for s in range(8):
        rows += [(s, k, None if r.random() < 0.5 else 100.0 + k + r.random()) for k in range(r.randint(1, 9))]
    points = spark.createDataFrame(rows, "spectrum_index long, o long, mz double")
    given = spark.createDataFrame(list(models.items()), "spectrum_index long, mz_delta_model array<double>")
    got = {(x.spectrum_index, x.o): x.mz for x in gaps.reconstruct(points, given, ["o"]).collect()}
    for s in range(8):
        x = [m for i, _, m in rows if i == s]
        known = [k for k, m in enumerate(x) if m is not None]
        for k, m in enumerate(x):
            left, right = [j for j in known if j <= k], [j for j in known if j >= k]
            if m is not None:
                want = m
            elif not known:
                want = None
            elif models.get(s):
                p = lambda v: sum(b * v**i for i, b in enumerate(models[s]))
                want = x[left[-1]] if left else x[right[0]]
                for _ in range(k - left[-1] if left else right[0] - k):
                    want = want + p(want) if left else want - p(want)
            elif left and right:
                want = x[left[-1]] + (x[right[0]] - x[left[-1]]) * (k - left[-1]) / (right[0] - left[-1])
            else:
                want = x[left[-1]] if left else x[right[0]]
            assert got[(s, k)] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_nearest_times_against_brute_force(spark, parts):
    r = random.Random(parts)
    spectra = [(i, r.choice([None, float("nan"), round(r.random() * 10, 1)])) for i in range(60)]
    asked = [(i, t) for i, t in enumerate([-5.0, 50.0, None, float("nan"), *[round(r.random() * 10, 2) for _ in range(30)], *[s[1] for s in spectra if s[1]][:5]])]
    got = {x.query_id: (x.spectrum_index, x.rt) for x in lookups.nearest_times(spark.createDataFrame(spectra, "spectrum_index long, rt double"), spark.createDataFrame(asked, "query_id long, time double"), parts=parts).collect()}
    known = [(t, i) for i, t in spectra if t is not None and t == t]
    for q, t in asked:
        if t is None or t != t:
            assert q not in got
        else:
            _, rt, i = min((abs(rt - t), rt, i) for rt, i in known)
            assert got[q] == (i, rt)
    none = spark.createDataFrame([], "spectrum_index long, rt double")
    assert lookups.nearest_times(none, spark.createDataFrame(asked, "query_id long, time double"), parts=parts).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("values", [[], [2.0], [1.0, 2.0], [5.0] * 30 + [1.0], [float(x * x % 97) / 4 - 9 for x in range(301)], [float("nan"), None, 3.0, float("inf"), 8.0, -0.0]])
def test_quantiles_against_numpy(spark, values, parts):
    at = (0.0, 0.25, 0.5, 0.75, 1.0)
    df = spark.createDataFrame([(v, 1) for v in values], "x double, part int")
    sound = [v for v in values if v is not None and np.isfinite(v)]
    got = tuple(analytics.quantiles(df, "x", at, parts).first())
    assert got == (pytest.approx(tuple(np.quantile(sound, at)), abs=1e-9) if sound else (None,) * 5)


def test_streamed_chromatogram(spark, tmp_path):
    from datetime import datetime, timedelta

    from ionloom.streaming import watch

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=20 * i), 100.0 + (i % 3), 1.0) for i in range(60)]
    spark.createDataFrame(rows, watch.POINTS).write.parquet(str(tmp_path / "in"))
    q = watch.write_stream(watch.windowed_xic(watch.point_stream(spark, str(tmp_path / "in")), 100.0, C.da(0.5), late="1 minute"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert len(got) >= 17 and all(r.points == 1 and r.intensity == 1.0 for r in got)


# ---- kernels ----


def _rows(streams):
    ends = np.cumsum([0] + [len(x) for x in streams])
    return np.frombuffer(b"".join(streams), np.uint8), ends[:-1], ends[1:]


def plain_integers(data):
    """One half-byte stream, integer by integer; None if it is cut off."""
    halves, out, at = [h for b in data for h in (b >> 4, b & 15)], [], 0
    while at < len(halves) and not (at == len(halves) - 1 and halves[at] != 8):
        head, at = halves[at], at + 1
        held = 8 - (head if head <= 8 else head - 8)
        if at + held > len(halves):
            return None
        value = sum(halves[at + j] << 4 * j for j in range(held)) | (0 if head <= 8 else 0xFFFFFFFF >> 4 * held << 4 * held)
        at += held
        out.append(value - (1 << 32) if value >> 31 else value)
    return out


@pytest.mark.parametrize("streams", [1, 5, codecs.LOCKSTEP + 30])
def test_streams_of_a_batch_are_read_like_single_ones(streams):
    r = np.random.default_rng(streams)
    broken = 0
    for _ in range(300):
        data = [r.integers(0, 256, int(r.integers(0, 14)), dtype=np.uint8).tobytes() for _ in range(streams)]
        data = [d for d in data if streams == 1 or plain_integers(d) is not None]
        want = [plain_integers(d) for d in data]
        if None in want:
            broken += 1
            with pytest.raises(ValueError, match="truncated"):
                codecs.unpack(*_rows(data))
            continue
        values, counts = codecs.unpack(*_rows(data))
        assert counts.tolist() == [len(w) for w in want] and values.tolist() == [x for w in want for x in w]
    assert broken or streams > 1


def test_batches_of_arrays_are_coded_like_single_ones():
    r = np.random.default_rng(3)
    arrays = [np.sort(r.uniform(50, 2000, n)) for n in [0, 1, 2, 3, 50, 0, 7] * 9]
    flat, counts = np.concatenate(arrays), np.array([len(a) for a in arrays])
    points = np.full(len(arrays), 1e5)
    for whole, one, back in ((codecs.encode_linear_batch(flat, counts, points), lambda a: codecs.encode_linear(a, 1e5), codecs.LINEAR), (codecs.encode_pic_batch(flat, counts), codecs.encode_pic, codecs.PIC), (codecs.encode_slof_batch(flat, counts, points / 100), lambda a: codecs.encode_slof(a, 1e3), codecs.SLOF)):
        singles = [one(a) for a in arrays]
        assert whole[0].tobytes() == b"".join(singles) and whole[1].tolist() == [len(s) for s in singles]
        values, held = codecs.DECODERS[back](*_rows(singles))
        assert held.tolist() == counts.tolist() and values.tolist() == [x for s in singles for x in codecs.decode(back, s)]


def test_coded_columns_keep_nulls_and_byte_lists(spark):
    rows = [(0, [100.0, 100.5, 101.25, 102.0]), (1, None), (2, []), (3, [7.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(1)
    coded = df.select("i", codecs.encoder(codecs.LINEAR)("v").alias("c"), codecs.encoder(codecs.LINEAR, 1e4)("v").alias("d"), codecs.encoder(codecs.SLOF)("v").alias("s"))
    lists = coded.withColumn("d", F.expr("transform(sequence(1, length(d)), k -> cast(conv(hex(substring(d, k, 1)), 16, 10) as int))"))
    back = {r.i: r for r in lists.select("i", codecs.decoder(codecs.LINEAR)("c").alias("c"), codecs.decoder(codecs.LINEAR)("d").alias("d"), codecs.decoder(codecs.SLOF)("s").alias("s")).collect()}
    for i, v in rows:
        assert (back[i].c, back[i].d, back[i].s) == (None, None, None) if v is None else all(list(x) == pytest.approx(v, rel=1e-3) for x in (back[i].c, back[i].d, back[i].s))


def test_best_fixed_points():
    """By hand: of one value 32 bits count, of more 31; residuals as 1 + size, rounded up."""
    assert codecs.linear_fixed_point([]) == 0 and codecs.linear_fixed_point([100.0]) == 0xFFFFFFFF // 100
    assert codecs.linear_fixed_point([100.0, 200.0]) == 0x7FFFFFFF // 200 and codecs.linear_fixed_point([100.0, 200.0, 1000.0]) == 0x7FFFFFFF // 701
    assert codecs.linear_fixed_point_for([100.0, 200.0], 1e-3) == 0 and codecs.linear_fixed_point_for([100.0, 200.0, 300.0], 1e-3) == 500
    assert codecs.linear_fixed_point_for([100.0, 200.0, 300.0], 1e-9) == -1


def test_chunks_are_summed_in_order():
    import pyarrow as pa

    from ionloom.operators.chunks import running_sums

    start = pa.array([0.1, None, 2.0, 3.0])
    values = pa.array([[0.2, None, 0.3], [1.0, 0.5], [], None], pa.list_(pa.float64()))
    assert running_sums(start, values).to_pylist() == [[0.1, 0.1 + 0.2, None, 0.1 + 0.2 + 0.3], [None, 1.0, 1.5], [2.0], [3.0]]
    assert running_sums(start[:0], values[:0]).to_pylist() == []


def test_chunks_are_decoded_without_a_shuffle(spark):
    from ionloom.operators import chunks

    c = spark.createDataFrame([(0, 0, 1.0, [1.0], "d", [1.0, 2.0])], "spectrum_index long, chunk_no long, mz_chunk_start double, mz_chunk_values array<double>, chunk_encoding string, intensity array<double>")
    t = c.select(F.col("spectrum_index").alias("chromatogram_index"), "chunk_no", F.col("mz_chunk_start").alias("time_chunk_start"), F.col("mz_chunk_values").alias("time_chunk_values"), "intensity")
    for df in (chunks.delta_points(c), chunks.chromatogram_points(t)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 2


def plain_filled(mz, model):
    """One spectrum, null by null."""
    known = [k for k, m in enumerate(mz) if m is not None]
    if not known:
        return mz
    out = list(mz)
    p = lambda x: sum(b * x**i for i, b in enumerate(model))
    for k in range(known[0] - 1, -1, -1):
        out[k] = out[k + 1] - p(out[k + 1]) if model else mz[known[0]]
    for k in range(known[0], len(mz)):
        if mz[k] is None:
            a, b = max(j for j in known if j < k), min((j for j in known if j > k), default=None)
            out[k] = out[k - 1] + p(out[k - 1]) if model else mz[a] if b is None else mz[a] + (mz[b] - mz[a]) * (k - a) / (b - a)
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_gaps_are_filled_across_batches(spark, batch):
    import random

    from ionloom.operators import gaps
    from ionloom.sources.storage import own_setting

    r = random.Random(batch)
    spectra = {i: [100.0 + k + r.random() if r.random() > r.choice([0.2, 0.9, 1.0]) else None for k in range(r.choice([1, 2, 9, 30]))] for i in range(60)}
    models = {i: [[0.01, 0.0002], None, [], [0.1, 1e-4, 1e-7]][i % 4] for i in spectra if i % 5}
    points = spark.createDataFrame([(i, k, m, 1.0) for i, s in spectra.items() for k, m in enumerate(s)], "spectrum_index long, k int, mz double, intensity double").repartition(3)
    given = spark.createDataFrame(list(models.items()), "spectrum_index long, mz_delta_model array<double>")
    with own_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)):
        got = {(x.spectrum_index, x.k): x.mz for x in gaps.reconstruct(points, given, ["k"]).collect()}
    for i, s in spectra.items():
        assert [got[i, k] for k in range(len(s))] == [m if m is None else pytest.approx(m, abs=1e-9) for m in plain_filled(s, models.get(i))]


def test_a_long_run_of_gaps_costs_its_length():
    from ionloom.operators import gaps

    mz, known = np.zeros(200_001), np.zeros(200_001, bool)
    mz[0], known[0] = 100.0, True
    assert gaps.filled(mz, known, None, [1e-6], True)[0] == 200_001 and mz[-1] == pytest.approx(100.2)


@pytest.mark.parametrize("tolerance", [C.ppm(2000), C.ppm(0), C.da(0.4)])
def test_range_join_against_every_pair(spark, tolerance):
    import random

    from ionloom.operators import analytics

    r = random.Random(9)
    targets = [(i, math_mz) for i, math_mz in enumerate([50.0, 5000.0, 0.0, -700.0, *(r.uniform(50, 5000) for _ in range(60))])]
    points = [(k, m * (1 + r.choice([0, 0.0019, -0.0019, 0.0021, 1e-4]))) for k, (_, m) in enumerate(targets * 4)] + [(-1, None)]
    got = analytics.target_range_join(spark.createDataFrame(points, "k long, mz double"), spark.createDataFrame([*targets, (99, None)], "target_id long, target_mz double"), tolerance)
    inside = lambda m, t: tolerance.limits(t)[0] <= m <= tolerance.limits(t)[1]
    want = sorted((k, i) for k, m in points if m is not None for i, t in targets if inside(m, t))
    assert sorted((x.k, x.target_id) for x in got.collect()) == want and want


@pytest.mark.parametrize("parts", [1, 7])
def test_ordinals(spark, parts):
    from ionloom.operators import lookups

    keys = [3 * k * k for k in range(40)]
    m = spark.createDataFrame([(k,) for k in reversed(keys)], "spectrum_index long")
    one = lambda n: [x.spectrum_index for x in lookups.by_ordinal(m, n, parts).collect()]
    assert [one(n) for n in (0, 17, 39, 40, -1)] == [[keys[0]], [keys[17]], [keys[39]], [], []]


def test_targets_of_one_mz(spark):
    """Targets that share an m/z meet the points once and are told apart behind the last shuffle; repeated ids are summed, and repeated targets stay."""
    points = spark.createDataFrame([(k % 3, 100.0 + k / 1000, float(k)) for k in range(12)], "spectrum_index long, mz double, intensity double")
    targets = [(k, 100.0 + (k % 2) / 100) for k in range(40)] + [(7, 100.0), (7, 100.01), (None, 100.0), (None, 100.0), (50, None)]
    frame = spark.createDataFrame(targets, "target_id long, target_mz double")
    metadata = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (2, 3.5)], "spectrum_index long, rt double")
    got = analytics.target_xic(metadata, points, frame, C.da(0.004))
    pairs = [(t, p) for t, m in targets if m is not None for p in points.collect() if m - 0.004 <= p.mz <= m + 0.004]
    assert analytics.target_range_join(points, frame, C.da(0.004)).count() == len(pairs)
    sums = {}
    for t, p in pairs:
        sums[t, p.spectrum_index] = sums.get((t, p.spectrum_index), 0.0) + p.intensity
    want = [(t, s, r.rt, v) for (t, s), v in sums.items() for r in metadata.collect() if r.spectrum_index == s]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert analytics.target_windows(points, frame, C.da(0.004)).count() == len({(m, p) for t, m in targets if m is not None for p in points.collect() if m - 0.004 <= p.mz <= m + 0.004})  # a pair a distinct m/z, however many targets have it


def test_tasks_of_gap_filling_follow_the_points(spark, monkeypatch):
    """More points than a task should sort are dealt to more tasks than the session's number, with the same result."""
    rows = [(k // 5, k % 5, None if k % 5 in (0, 2, 3) else float(k), 1.0) for k in range(400)]
    points = spark.createDataFrame(rows, "spectrum_index long, k int, mz double, intensity double")
    models = spark.createDataFrame([(3, [0.5])], "spectrum_index long, mz_delta_model array<double>")
    fills = (lambda: gaps.linear_fill(points, ["k"]), lambda: gaps.poly_fill(points, models, ["k"]))
    want = [sorted(f().collect()) for f in fills]
    monkeypatch.setattr("ionloom.sources.storage.ROWS_A_TASK", 20)
    for f, rows in zip(fills, want):
        assert f().rdd.getNumPartitions() == 20 and sorted(f().collect()) == rows
