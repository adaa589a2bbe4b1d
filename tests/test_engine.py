"""The engine's operators: reference values of the formats, edge rows, and DuckDB on every query that has SQL."""

import hashlib
import json
import math
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import aces, color, curve, transfer
from lumenforge.functions.curve import Curve
from lumenforge.functions.num import clamp, quantize
from lumenforge.operators import export, fidelity, integrity, pixels, regions, temporal, tonemap, validation
from lumenforge.plans import jobs
from lumenforge.queries import REGISTRY, dynamic_frames, gain_frames, signal
from lumenforge.sources import bitstream, container, images, metadata

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_matches_sql(spark, data, duck, name):
    f, sql = REGISTRY[name]
    a, b = f(spark, data).toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    text = {c: pd.api.types.is_object_dtype(a[c]) or pd.api.types.is_string_dtype(a[c]) for c in cols}
    norm = lambda d: d[cols].apply(lambda s: s.map(lambda v: "" if v is None or v is pd.NA or v != v else str(v)) if text[s.name] else s.astype(float)).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False, rtol=0, atol=2e-6)


def test_every_query_has_sql():
    assert all(sql for _, sql in REGISTRY.values())


def test_known_values(spark):
    assert value(spark, transfer.nits_to_pq(203.0)) == pytest.approx(0.58068888, abs=1e-6)
    assert value(spark, transfer.pq_to_nits(transfer.pq_encode(F.lit(0.0203)))) == pytest.approx(203.0, abs=1e-6)
    assert value(spark, transfer.nits_to_pq(-1.0)) is None and value(spark, transfer.nits_to_pq(10_001.0)) is None
    assert value(spark, transfer.srgb_decode(transfer.srgb_encode(F.lit(0.4)))) == pytest.approx(0.4, abs=1e-10)
    assert math.isnan(value(spark, clamp(float("nan")))) and value(spark, quantize(0.5, 3)) == 2
    assert value(spark, export.scale_bits(F.lit(10_000.0), 10)) == 1023 and value(spark, export.scale_bits(F.lit(5_000.0), 16)) == 32_768
    assert value(spark, export.distribution(F.lit(10_000.0), export.PCT10, 10)) == [10, 51, 102, 256, 512, 767, 921, 972, 1003, 1013]
    rgb = (F.lit(0.3), F.lit(0.6), F.lit(0.2))
    back = color.from_ycbcr(*color.to_ycbcr(rgb))
    assert [value(spark, c) for c in back] == pytest.approx([0.3, 0.6, 0.2], abs=1e-12)
    there = color.rec2020_to_rec709(color.rec709_to_rec2020(rgb))
    assert [value(spark, c) for c in there] == pytest.approx([0.3, 0.6, 0.2], abs=1e-6)


def test_aces_mid_grey():
    grey = np.full((3, 1), 0.18)
    assert aces.rrt(grey).ravel() == pytest.approx([4.8] * 3, abs=1e-6)
    sdr = aces.odt_rec709(aces.rrt(grey)).ravel()
    assert np.ptp(sdr) < 1e-6 and 0.35 < sdr[0] < 0.45
    y = (15 / 10_000) ** transfer.M1
    pq15 = ((transfer.C1 + transfer.C2 * y) / (1 + transfer.C3 * y)) ** transfer.M2
    for peak in (1000.0, 4000.0):
        assert aces.output_rec2020_pq(grey, peak).ravel() == pytest.approx([pq15] * 3, abs=1e-6)
    assert np.isfinite(aces.output_rec2020_pq(np.array([[0.0, -0.1, 50.0], [0.0, 0.2, 0.1], [0.0, 0.9, 0.0]]), 1000.0)).all()


def test_curves(spark):
    c = curve.Curve()
    for x, y in (*curve.DEFAULT_ANCHORS, (-0.5, 0.0), (1.5, 1.0)):
        assert value(spark, c.evaluate(x)) == pytest.approx(y, abs=1e-9)
    steep = curve.Curve("bezier", ((0.0, 0.0), (0.1, 0.9), (0.9, 0.91), (1.0, 1.0)))
    ys = [r.y for r in spark.range(101).select(steep.evaluate(F.col("id") / 100).alias("y")).collect()]
    assert ys == sorted(ys) and 0 <= ys[0] and ys[-1] <= 1
    assert curve.anchor_problem(((0.0, 0.0), (0.5, 0.2), (0.5, 0.3), (1.0, 1.0))) and not curve.anchor_problem(curve.DEFAULT_ANCHORS)
    assert curve.Grid(2, 2, ((1.0, 0.0),)).problem() and value(spark, curve.Grid(2, 2, ()).sample(0.5, 0.5)[0]) == 1.0
    assert value(spark, curve.ambient_boost(50.0, (), ())) == 1.0 and value(spark, curve.ambient_boost(50.0, (10.0,), (1.2,))) == 1.2


def test_identical_frames(spark):
    df = spark.createDataFrame([(0, i, 0.1 * i, 0.5, 0.2) for i in range(9)], "frame_index long, pixel_idx long, r double, g double, b double")
    m = fidelity.frame_metrics(fidelity.paired(df, df)).first()
    assert m.psnr_db == float("inf") and m.ssim == pytest.approx(1.0) and m.delta_e == 0.0
    one = fidelity.frame_metrics(fidelity.paired(df.limit(1), df)).first()
    assert one.ssim == pytest.approx(1.0)
    bad = df.select(F.lit(30.0).alias("psnr_db"), F.lit(None).cast("double").alias("ssim"), F.lit(5.0).alias("delta_e"), F.lit(90.0).alias("vmaf_hdr"))
    assert value(spark, F.lit(1)) == 1 and [f.split()[0] for f in bad.select(fidelity.contract_failures().alias("f")).first().f] == ["PSNR", "SSIM", "DeltaE"]


def test_tone_map_edges(spark):
    schema = "pixel_idx long, nx double, ny double, r double, g double, b double"
    df = spark.createDataFrame([(0, 0.0, 0.0, float("nan"), float("inf"), 0.5), (1, 0.5, 0.5, 0.0, 1.0, 2.0)], schema)
    out = tonemap.tone_map(df, curve.Curve()).orderBy("pixel_idx").collect()
    assert all(0 <= v <= 1 for r in out for v in (r.r, r.g, r.b))
    assert tonemap.Target(float("nan"), -1).range() == (0.0, 1000.0) and tonemap.Target(2000, 500).range() == (0.0, 500)
    dither = tonemap.splitmix_dither(np.arange(20_000))
    assert (np.abs(dither) < 1).all() and abs(dither.mean()) < 0.01 and (dither == tonemap.splitmix_dither(np.arange(20_000))).all()
    sdr = tonemap.to_sdr(spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(5)] + [(i, 0.58, 0.58, 0.58) for i in range(5, 50)], "pixel_idx long, r double, g double, b double"), curve.Curve("linear", ((0.0, 0.0), (1.0, 1.0)))).collect()
    assert all((r.r, r.g, r.b) == (0, 0, 0) for r in sdr if r.pixel_idx < 5) and all(max(r.r, r.g, r.b) - min(r.r, r.g, r.b) <= 1 for r in sdr)


def test_regions(spark):
    cap = F.struct(F.lit(math.pi).alias("centre_azimuth"), F.lit(0.0).alias("centre_elevation"), F.lit(0.4).alias("angular_width"), F.lit(1.0).alias("angular_height"))
    assert value(spark, regions.inside_cap(F.lit(-math.pi + 0.1), F.lit(0.0), cap)) and not value(spark, regions.inside_cap(F.lit(0.0), F.lit(0.0), cap))
    ties = "array(named_struct('priority', 5, 'ordinal', 0, 'region_id', 1), named_struct('priority', 5, 'ordinal', 1, 'region_id', 2), named_struct('priority', 4, 'ordinal', 2, 'region_id', 3))"
    assert value(spark, regions.governing(F.expr(ties), lambda r: F.lit(True))["region_id"]) == 2
    assert value(spark, regions.governing(F.expr(ties), lambda r: F.lit(False))) is None


def test_gain_against_pumping():
    drift = lambda w: [(g := temporal.Gain(w), [g.step(1 - 0.015 * i, 0.5, 0.8, 0.05) for i in range(20)])[1] for _ in (0,)][0]
    still, windowed = drift(0), drift(12)
    assert windowed[-1] - still[-1] > 0.02 and all(0.35 <= x <= 1 for x in still + windowed)
    c = temporal.Controller()
    s = temporal.Gain(12)
    assert c.apply(s, None, 0.5) == 1.0 and c.apply(s, 20.0, 0.5, locked=True) == 1.0 and s.last == 1.0
    assert temporal.frame_duration(24) == 3750 and temporal.frame_duration(1e9) == 1


def test_stream_folds_like_batch(spark, data, tmp_path):
    from lumenforge.streaming.gain import stabilise_stream

    frames = gain_frames(spark, "/root/testdata/sf0.01")
    want = {(r.stream_id, r.frame_index): r.gain for r in temporal.stabilise(frames).collect()}
    local = frames.toPandas().sort_values("frame_index")
    folder = tmp_path / "frames"
    for k in range(3):
        part = local.iloc[k * len(local) // 3 : (k + 1) * len(local) // 3]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = stabilise_stream(stream).writeStream.format("memory").queryName("gains").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.stream_id, r.frame_index): r.gain for r in spark.table("gains").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_late_frames_are_given_out_as_late(spark, tmp_path):
    from lumenforge.streaming.gain import stabilise_stream

    rows = [("a", i, 20.0, 0.5, False) for i in (0, 1, 4, 2, 5)] + [("b", 0, 20.0, 0.4, False), ("b", 0, 9.0, 0.4, False)]
    schema = "stream_id string, frame_index long, frame_time_ms double, luma double, locked boolean"
    for part in (rows[:3], rows[3:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    stabilise_stream(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.stream_id, r.frame_index, r.late, r.gain is None) for r in spark.table("late").collect()]
    assert sorted(got) == [("a", 0, False, False), ("a", 1, False, False), ("a", 2, True, True), ("a", 4, False, False), ("a", 5, False, False), ("b", 0, False, False), ("b", 0, True, True)]
    want = {r.frame_index: r.gain for r in temporal.stabilise(spark.createDataFrame([r for r in rows[:5] if r[1] != 2], schema)).collect()}
    assert {r.frame_index: r.gain for r in spark.table("late").where("stream_id = 'a' and not late").collect()} == pytest.approx(want)


def test_gain_reaches_the_pixels(spark):
    pixels_ = spark.createDataFrame([("a", f, p, 0.4 + 0.1 * p, 0.5, 0.6, 0.0, 0.0) for f in range(6) for p in range(4)], "stream_id string, frame_index long, pixel_idx long, r double, g double, b double, nx double, ny double")
    times = spark.createDataFrame([("a", f, None if f == 2 else 25.0, f == 4) for f in range(6)], "stream_id string, frame_index long, frame_time_ms double, locked boolean")
    policy = tonemap.Policy(deterministic=False)
    plain = {(r.frame_index, r.pixel_idx): r.g for r in tonemap.tone_map(pixels_, Curve(), policy=policy).collect()}
    got = {(r.frame_index, r.pixel_idx): r.g for r in tonemap.tone_map_stateful(pixels_, times, Curve(), temporal.Controller(), policy=policy).collect()}
    assert got.keys() == plain.keys() and all((got[k] == plain[k]) == (k[0] in (2, 4)) for k in got)
    assert got[(5, 0)] < got[(0, 0)] < plain[(0, 0)]


def test_encoders_get_frames_in_order(spark):
    packets = spark.createDataFrame([("a", i, k) for k, i in enumerate((0, 1, 3, 2, 4, 4, None, 7))], "stream_id string, frame_index long, arrival long")
    got = {r.arrival: (r.position, r.failure) for r in temporal.encode_order(packets).collect()}
    assert [got[k][1] for k in (0, 1, 2, 4)] == [None] * 4 and got[3][1] == "frame comes after a later one" and got[5][1] == "frame index comes twice" and got[6][1] == "frame index is missing" and got[7][1] == "frames are missing before this one"
    assert [got[k][0] for k in (6, 0, 1, 3, 2)] == [0, 1, 2, 3, 4]


def test_validators(spark):
    d = F.from_json(F.lit(json.dumps({"metadata_schema_version": 2, "frame_index": 0, "scene_peak_luminance_nits": 100, "scene_average_luminance_nits": 10, "tone_map_curve": {"type": "linear", "anchors": [{"input": 0, "output": 0}, {"input": 1, "output": 1}]}, "target_display_hint": {"min_luminance_nits": 0, "max_luminance_nits": 1000}, "open_dynamic_v2": {"temporal": {"max_global_gain_delta_per_frame": 0.1, "anti_pumping_strength": 0.5}, "scene_constraints": [{"scene_id": "a", "start_frame": 0, "end_frame": 1, "max_highlight_compression_gain": 1}, {"scene_id": "a", "start_frame": 0, "end_frame": 1, "max_highlight_compression_gain": 1}]}})), validation.DYNAMIC)
    assert value(spark, validation.first_failure(validation.dynamic_meta(d))) == "scene constraint scene_id must be unique"
    assert value(spark, validation.unknown_keys(F.lit('{"a":1,"b":2}'), ("a",))) == ["b"] and value(spark, validation.unknown_keys(F.lit(None).cast("string"), ("a",))) == []
    assert value(spark, validation.relative_path(F.lit("a/../b"))) is False and value(spark, validation.relative_path(F.lit("a/b"))) is True
    s = "named_struct('tier','delivery','precision','float32','format_version','1','metadata_schema_version',1,'colour_standard','rec2100','colour_primaries','rec2020','transfer_function','{}','dynamic_metadata_standard','st2094','mastering_display',named_struct('red_primary',named_struct('x',0.7D,'y',0.3D),'green_primary',named_struct('x',0.2D,'y',0.8D),'blue_primary',named_struct('x',0.1D,'y',0.1D),'white_point',named_struct('x',0.3D,'y',0.3D),'min_luminance_nits',0D,'max_luminance_nits',1000D),'content_light_level',named_struct('max_cll_nits',1000D,'max_fall_nits',400D),'compatibility_tags',array('a'))"
    assert value(spark, validation.first_failure(validation.static_meta(F.expr(s.format("st2084_pq"))))) is None
    assert "st2084_pq" in value(spark, validation.first_failure(validation.static_meta(F.expr(s.format("linear")))))


def test_metadata_exports(spark, data):
    rows = export.profile_export(dynamic_frames(spark, data), "advanced").collect()
    assert len(rows) == 5 and all(r.entry.colour_saturation_gain == 32_768 and len(r.entry.distribution_values_16bit) == 15 for r in rows)
    assert value(spark, export.parse_keyframe(F.lit("3:0.5:-1"))).dy == -1.0 and value(spark, export.parse_keyframe(F.lit("3:x:1"))) is None


def test_manifests(spark):
    df = spark.createDataFrame([(b"abc",), (None,)], "payload binary")
    signed = integrity.sign(df, "me", b"key")
    assert [r.failure for r in integrity.verify(signed, b"key").collect()] == [None, None]
    assert {r.failure for r in integrity.verify(signed, b"other").collect()} == {"signature mismatch"}
    assert {r.failure for r in integrity.verify(signed.withColumn("signature_hex", F.lit("zz")), b"key").collect()} == {"manifest is malformed"}
    with pytest.raises(ValueError):
        integrity.sign(df, "x" * 2000, b"key")


def test_signing_keys(tmp_path):
    f = tmp_path / "key"
    f.write_bytes(b"secret\r\n")
    assert integrity.signing_key("k") == b"k" and integrity.signing_key(key_file=str(f)) == b"secret" and integrity.signing_key(default=b"d") == b"d"
    f.write_bytes(b"\n")
    for bad in ({"key": "a", "key_file": "b"}, {"key": ""}, {}, {"key_file": str(f)}):
        with pytest.raises(ValueError):
            integrity.signing_key(**bad)


def test_signatures_are_those_of_the_standard_library(spark):
    rows = spark.createDataFrame([("a",), ("é" * 50,), (None,)], "payload string")
    for key in (b"a test key", b"long" * 40):
        m = integrity.sign(rows, "stúdio", key, domain=b"other\0")
        for r in m.collect():
            digest = hashlib.sha256((r.payload or "").encode()).digest()
            assert r.signature_hex == integrity.hmac_hex(digest, "stúdio".encode(), key, b"other\0")
        plan = m._jdf.queryExecution().toString()
        assert key.decode() not in plan and bytes(x ^ 0x36 for x in key[:8]).hex() not in plan.lower()
        failures = [r.failure for r in integrity.verify(m.withColumn("signature_algorithm", F.when(F.col("payload") == "a", "sha256-keyed").otherwise(F.col("signature_algorithm"))), key, domain=b"other\0").collect()]
        assert failures == ["legacy sha256-keyed signature is not accepted; re-sign with hmac-sha256", None, None]


def test_container_files(spark, tmp_path):
    rows = [(n, 2, "delivery", codec, 2, 1, frames, '{"metadata_schema_version":2}', i, None if i % 2 else f'{{"frame_index":{i}}}', bytearray(struct.pack("<6f", *[i] * 6) if codec == 0 else b"xy" * i)) for n, codec, frames in (("a.bin", 0, 7), ("b.bin", 1, 5)) for i in range(frames)]
    schema = "name string, version int, tier string, codec int, width int, height int, frame_count int, static_meta string, frame_index long, dynamic_meta string, payload binary"
    df, folder = spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "out")
    container.write_containers(df, folder)
    for options in ({}, {"range_frames": "2", "long_file": "1"}):
        back = spark.read.format("frames").options(path=folder, payload="true", **options).load()
        assert sorted((r.path.split("/")[-1], r.frame_index, bytes(r.payload)) for r in back.collect()) == sorted((r[0], r[8], bytes(r[10])) for r in rows)
    assert back.rdd.getNumPartitions() == 4 + 3
    data = (tmp_path / "out" / "a.bin").read_bytes()
    assert len(container.parse(data)[2]) == 7
    for bad, why in (((0, "x"), None), (None, "frame")):
        broken = df.where("name = 'a.bin' and frame_index != 3") if why else df.withColumn("name", F.concat(F.lit("../"), "name"))
        with pytest.raises(Exception, match="belongs|name must"):
            container.write_containers(broken, folder)
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin", "b.bin"]
    container.write_containers(df.where("name = 'b.bin'"), folder, mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.bin"]
    (tmp_path / "cut.bin").write_bytes(data[:-3])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("frames").options(path=str(tmp_path / "cut.bin"), range_frames="2", long_file="1").load().count()
    (tmp_path / "cut.bin").write_bytes(data + b"x")
    with pytest.raises(Exception, match="after the last frame"):
        spark.read.format("frames").options(path=str(tmp_path / "cut.bin")).load().count()


def test_still_pictures():
    data = bitstream.write_avif(b"item" * 9, 64, 32, b"{}")
    assert bitstream.read_avif(data) == {1: b"item" * 9, 2: b"{}"} and bitstream.read_avif(bitstream.write_avif(b"i", 1, 1)) == {1: b"i"}
    assert data[4:12] == b"ftypavif" and bitstream.find(data, "mdat") and struct.unpack(">II", data[data.index(b"ispe") + 8 :][:8]) == (64, 32)
    for bad in ((b"", 1, 1, None), (b"x", 0, 1, None), (b"x", 1, 1, b"")):
        with pytest.raises(bitstream.BitstreamError):
            bitstream.write_avif(*bad)
    with pytest.raises(bitstream.BitstreamError):
        bitstream.read_avif(b"\0\0\0\x08free")


def test_packers_are_run_without_a_shell(spark, data, tmp_path):
    assert export.adapter_command("pack -i {sidecar} -o '{rpu} x' {report}", "a b", "c;d", "e") == ["pack", "-i", "a b", "-o", "c;d x", "e"]
    for bad in ("pack 'open", "pack {sidecar}"):
        with pytest.raises(ValueError):
            export.adapter_command(bad, "a\0", "b", "c")
    assert export.run_adapter(None, "a", "b", "c")["error"] and not export.run_adapter("no-such-program-here {rpu}", "a", "b", "c")["command_detected"]
    sidecars = dynamic_frames(spark, data).select(export.open_sidecar(F.col("dynamic_meta")).alias("sidecar"))
    row = jobs.packed_sidecars(spark, sidecars, str(tmp_path), "cp {sidecar} {rpu}").first()
    assert row.invocation_succeeded and row.compatibility.mode == "proprietary_adapter_packaged" and not row.compatibility.missing_capabilities
    assert len((tmp_path / "rpu.bin").read_text().splitlines()) == sidecars.count()
    row = jobs.packed_sidecars(spark, sidecars, str(tmp_path), "false").first()
    assert not row.invocation_succeeded and "failed" in row.error and row.compatibility.mode == "open_sidecar_only" and len(row.compatibility.missing_capabilities) == 3
    assert set(jobs.write_bundle(jobs.interop_bundle(dynamic_frames(spark, data), signal(spark, data)), str(tmp_path / "bundle"))) == {"hdr10", "hdr10plus", "sidecar", "loss", "frame_loss"}


def test_container(spark, tmp_path):
    body = np.arange(24, dtype="<f4").tobytes()
    head = container.Header(1, "delivery", 0, 4, 2, 2, 0)
    data = container.build(head, "{}", [('{"frame_index":0}', body), ('{"frame_index":1}', body)])
    (tmp_path / "a.bin").write_bytes(data)
    spark.dataSource.register(container.ContainerSource)
    rows = spark.read.format("frames").option("path", str(tmp_path)).load().orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == [0, 1] and all(data[r.payload_offset : r.payload_offset + r.payload_length] == body for r in rows)
    assert container.raw_pixels(body, "delivery").shape == (8, 3)
    coded = container.build(container.Header(2, "mastering", 1, 4, 2, 1, 0), '{"metadata_schema_version":2}', [("{}", b"xyz")])
    assert container.parse(coded)[2][0][3] == 3
    for bad in (b"XXXX" + data[4:], data[:4] + struct.pack("<H", 9) + data[6:], data[:-1], data + b"x", data[:20], data[:20] + b"\1\0\0\0" + data[24:], container.build(head, "{}", [('{"frame_index":5}', body)])):
        with pytest.raises(container.ContainerError):
            container.parse(bad)
    with pytest.raises(container.ContainerError):
        container.raw_pixels(np.array([np.nan, 0, 0], "<f4").tobytes(), "delivery")
    assert container.compressed_budget(1) == 256 << 10 and container.compressed_budget(1 << 40) == 512 << 20


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def test_bitstreams(spark):
    for v in (0, 127, 128, 300, 1 << 40):
        assert bitstream.read_leb128(bitstream.write_leb128(v), 0) == (v, len(bitstream.write_leb128(v)))
    with pytest.raises(bitstream.BitstreamError):
        bitstream.read_leb128(b"\x80" * 9, 0)
    unit = bytes([2 << 3 | 2, 0, 6 << 3 | 2, 3, 1, 2, 3])
    two = bitstream.embed(bitstream.embed(unit, b"one"), b"two")
    assert bitstream.extract(two) == [b"one", b"two"] and [k for k, *_ in bitstream.units(two)] == [2, 5, 5, 6]
    assert bitstream.extract(unit) == [] and bitstream.extract(b"") == []
    ivf = bitstream.write_ivf([two, unit], 16, 8, 24.0)
    assert [f for _, f in bitstream.read_ivf(ivf)] == [two, unit]
    full = lambda *v: struct.pack(f">{len(v)}I", *v)
    mdat = box(b"mdat", two, unit)
    ftyp = box(b"ftyp", b"isom")
    at = len(ftyp) + 8
    stbl = box(b"stbl", box(b"stsz", full(0, 0, 2, len(two), len(unit))), box(b"stsc", full(0, 1, 1, 2, 1)), box(b"stco", full(0, 1, at)))
    mp4 = ftyp + mdat + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))))
    assert [mp4[a : a + n] for a, n in bitstream.mp4_samples(mp4)] == [two, unit]
    size = len(box(b"moof", box(b"traf", box(b"tfhd", full(0, 1)), box(b"trun", full(0x201, 2, 0, len(two), len(unit))))))
    frag = ftyp + box(b"moof", box(b"traf", box(b"tfhd", full(0, 1)), box(b"trun", full(0x201, 2, size + 8, len(two), len(unit))))) + mdat
    assert [frag[a : a + n] for a, n in bitstream.mp4_samples(frag)] == [two, unit]
    df = spark.createDataFrame([("a", ivf), ("b", mp4), ("c", two), ("d", ivf[:-2]), ("e", None)], "path string, content binary")
    rows = bitstream.probe(df).collect()
    assert {(r.path, r.kind, bytes(r.payload)) for r in rows if r.payload} == {(p, k, v) for p, k in (("a", "ivf"), ("b", "mp4"), ("c", "obu")) for v in (b"one", b"two")}
    assert [r.path for r in rows if r.error] == ["d"]


def test_binary_metadata(spark):
    meta = {"metadata_schema_version": 2, "frame_index": 3}
    data = metadata.encode(meta)
    assert metadata.decode_dynamic(data) == meta and metadata.decode_static(metadata.encode(meta, metadata.STATIC_NAME)) == meta
    old = struct.pack("<QffBBxxff", 7, 100.0, 10.0, 1, 2, 0.0, 1000.0) + struct.pack("<4f", 0, 0, 1, 1)
    assert metadata.decode_dynamic(old)["tone_map_curve"] == {"type": "linear", "anchors": [{"input": 0.0, "output": 0.0}, {"input": 1.0, "output": 1.0}]}
    fixed = (metadata.STATIC_V1_NAME + bytes([1, 1, 0, 0]) + struct.pack("<10d2f", *[0.1] * 8, 0.0, 1000.0, 900.0, 300.0)).ljust(128, b"\0")
    assert metadata.decode_static(fixed)["content_light_level"] == {"max_cll_nits": 900.0, "max_fall_nits": 300.0}
    for bad in (data + b"x", data[:-1], old + b"x", old[:-1], b"", old[:16] + b"\7" + old[17:]):
        with pytest.raises(metadata.MetadataError):
            metadata.decode_dynamic(bad)
    for bad in (fixed + b"x", fixed[:100], b"", fixed[:8] + b"\7" + fixed[9:]):
        with pytest.raises(metadata.MetadataError):
            metadata.decode_static(bad)
    rows = metadata.decode_table(spark.createDataFrame([(1, data), (2, b"no"), (3, None)], "i long, content binary")).collect()
    assert [bool(r.error) for r in rows] == [False, True, True]


def test_motion_rules(spark):
    region = "named_struct('x', 0.1D, 'y', 0.1D, 'width', 0.2D, 'height', 0.2D, 'motion', named_struct('kind', 'piecewise_linear', 'frame_count', 0L, 'dx_per_frame', 0D, 'dy_per_frame', 0D, 'keyframes', array({})))"
    key = "named_struct('frame_delta', {}L, 'dx', {}D, 'dy', 0D)"
    said = lambda *k: value(spark, validation.first_failure(validation.region_motion(F.expr(region.format(", ".join(key.format(*x) for x in k))))))
    assert said((0, 0.0), (5, 0.3)) is None and "two keyframes" in said((0, 0.0)) and "start" in said((1, 0.0), (2, 0.1))
    assert "increasing" in said((0, 0.0), (5, 0.1), (5, 0.2)) and "leaves" in said((0, 0.0), (5, 0.9))
    c = F.struct(F.lit(11).alias("speed"), F.lit(0).alias("quantizer"), F.lit(True).alias("lossless"))
    assert "speed" in value(spark, validation.first_failure(validation.encoder_config(c)))


def test_images(spark, tmp_path):
    df = spark.createDataFrame([(0, i, i, 2 * i, 3 * i) for i in range(6)], "frame_index long, pixel_idx long, r int, g int, b int")
    ppm = images.frames_as_bytes(df, 3, "ppm8").first().content
    assert bytes(ppm).startswith(b"P6\n3 2\n255\n") and bytes(ppm)[-3:] == bytes([5, 10, 15])
    images.write_images(images.frames_as_bytes(df, 3), str(tmp_path / "out"), "raw")
    assert len((tmp_path / "out" / "000000.raw").read_bytes()) == 36


def test_chroma_needs_even_width(spark):
    with pytest.raises(ValueError):
        pixels.subsample_420(spark.range(1), 3)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())


def test_jobs(spark, data, tmp_path):
    from lumenforge.plans import jobs

    (tmp_path / "x.bin").write_bytes(container.build(container.Header(2, "delivery", 0, 2, 1, 1, 0), json.dumps(jobs.static_metadata()), [(json.dumps(jobs.dynamic_metadata(v2=True)), bytes(24))]))
    assert jobs.info(spark, str(tmp_path / "x.bin")).first().frames_read == 1
    static = json.dumps(jobs.static_metadata("mastering"))
    schema = spark.read.json(spark.sparkContext.parallelize([static])).schema
    assert value(spark, validation.first_failure(validation.static_meta(F.from_json(F.lit(static), schema)))) is None
    for v2 in (False, True):
        d = F.from_json(F.lit(json.dumps(jobs.dynamic_metadata(v2=v2))), validation.DYNAMIC)
        assert value(spark, validation.first_failure(validation.dynamic_meta(d))) is None
    assert jobs.pq(spark, [203.0, -1.0]).collect()[1].signal is None
    run = jobs.conformance_run(jobs.conformance_generate(spark, 2, 16, 16)).collect()
    assert len(run) == 2 and all(r.passed and r.psnr_db > 35 for r in run)
    seen = jobs.inspect(jobs.write_test(spark, "delivery").withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0)})).first()
    assert 0 < seen.mean_after <= 1 and 0 < seen.mean_before <= 1
    bundle = jobs.interop_bundle(dynamic_frames(spark, data), jobs.write_test(spark, "delivery"))
    assert all(df.count() for df in bundle.values()) and json.loads(bundle["hdr10plus"].first().json)["profile"] == "advanced"
    assert jobs.aces_export(jobs.write_test(spark), "rec709_100nit").count() == 64
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.ivf").write_bytes(bitstream.write_ivf([bitstream.embed(bytes([6 << 3 | 2, 0]), b"m")], 4, 4, 24.0))
    assert bytes(jobs.probe(spark, str(tmp_path / "s")).first().payload) == b"m"
    moved = json.loads(jobs.object_motion("translate", (0.1, 0.1, 0.2, 0.2), 5, (0.5, 0.3)))
    assert moved["motion"]["dx_per_frame"] == pytest.approx(0.1)
