import gzip
import json
import os

import numpy as np
import pytest

from frameloom import cli
from frameloom.plans import job, presets
from frameloom.sources import fits, jpeg, tiff

from test_operators import star_field


@pytest.mark.parametrize("bitpix,kind", [(8, "u1"), (16, "i2"), (32, "i4"), (64, "i8"), (-32, "f4"), (-64, "f8")])
def test_fits_types_scaling_and_header(bitpix, kind):
    data = np.arange(12).reshape(3, 4)
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bitpix:20d}", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    3", "BSCALE  =                  2.0", "BZERO   =                    5", "EXPTIME =                 30.5", "OBJECT  = 'M 31''s core'      / name", "DATE-OBS= '2020-01-02T03:04:05'", "COMMENT a remark", "HISTORY a step"]
    raw = "".join(c.ljust(80) for c in [*cards, "END"]).ljust(2880).encode() + data.astype(">" + kind).tobytes().ljust(2880, b"\0")
    for content in (raw, gzip.compress(raw)):
        got = fits.parse(content)
        np.testing.assert_allclose(got.data[0], data * 2 + 5)
        assert got.exposure == 30.5 and got.naxisn == (4, 3) and got.header.strings["OBJECT"] == "M 31's core"
        assert got.header.dates["DATE-OBS"].startswith("2020") and got.header.comments == ["a remark"] and got.header.history == ["a step"]
    assert fits.parse(raw, with_data=False).data is None


def test_fits_round_trip_with_long_strings_and_nan():
    h = fits.Header(strings={"NOTE": "x" * 150}, ints={"N": 3}, floats={"G": 1.5}, bools={"B": True}, comments=["c"])
    data = np.random.default_rng(0).random((3, 4, 5)).astype(np.float32)
    data[0, 0, 0] = np.nan
    back = fits.parse(fits.encode(fits.Image(data, h, exposure=12.0)))
    np.testing.assert_array_equal(back.data, np.nan_to_num(data))
    assert back.exposure == 12 and back.header.strings["NOTE"] == "x" * 150 and back.header.ints["N"] == 3 and back.header.floats["G"] == 1.5 and back.header.bools["B"]
    with pytest.raises(ValueError):
        fits.parse(b"x" * 100)


@pytest.mark.parametrize("ch,bits", [(1, 8), (1, 16), (3, 8), (3, 16)])
def test_tiff_round_trip(ch, bits):
    top = (1 << bits) - 1
    data = np.random.default_rng(1).integers(0, top, (ch, 5, 7)).astype(float)
    np.testing.assert_array_equal(tiff.parse(tiff.encode(data, 0, top, 1.0, bits)).data, data)


def test_jpeg_preview(spark):
    raw = jpeg.encode(spark, np.random.default_rng(1).random((3, 20, 30)), 0, 1)
    assert raw[:3] == b"\xff\xd8\xff" and len(raw) > 500


@pytest.fixture
def folder(tmp_path):
    base, _ = star_field(0)
    for i in range(6):
        noise = np.random.default_rng(100 + i).normal(0, 0.002, base.shape)
        data = np.roll(base + noise, (i % 2, i % 3), (0, 1)).astype(np.float32)
        (tmp_path / f"light{i}.fits").write_bytes(fits.encode(fits.Image(data[None], exposure=10.0)))
    return tmp_path


def state(spark, folder):
    return job.PipelineState(spark, f"file://{folder}", f"file://{folder}")


def test_registry_has_all_operators_and_documents_round_trip():
    assert len(job.REGISTRY) == 45
    for kind in job.REGISTRY:
        op = job.from_json({"type": kind})
        doc = json.loads(json.dumps(op.to_json()))
        assert job.from_json(doc) == op
    nested = job.from_json({"type": "seq", "steps": [{"type": "starDetect", "sigma": 8, "save": {"filePattern": "s%d.fits"}}, {"type": "hslRotateHue", "from": 5}]})
    assert nested.steps[0].save.filePattern == "s%d.fits" and nested.steps[1].from_ == 5 and nested.to_json()["steps"][1]["from"] == 5
    with pytest.raises(ValueError):
        job.from_json({"type": "nonsense"})


def test_unsafe_paths_are_refused(spark, folder):
    for bad in ("/etc/passwd", "../x.fits", "a/../../x.fits"):
        with pytest.raises(ValueError):
            job.LoadMany([bad]).run(state(spark, folder))
        with pytest.raises(ValueError):
            job.Save(bad).run(job.LoadMany(["light0.fits"]).run(state(spark, folder)))
    assert job.file_name("a%04d.fits", 7) == "a0007.fits" and job.file_name("a%d.fits", 7) == "a7.fits"


def test_stack_job_end_to_end(spark, folder):
    plan = presets.pipeline("stack", {"out": "out.fits", "starSig": 10.0, "starRadius": 8, "stars": "", "tiff": "out.tif", "alignK": 6}, ["light*.fits"])
    plan = job.from_json(json.loads(json.dumps(plan.to_json())))
    plan.run(state(spark, folder))
    got = fits.parse((folder / "out.fits").read_bytes())
    base, _ = star_field(0)
    assert got.exposure == pytest.approx(60.0)
    inner = np.s_[4:-4, 4:-4]
    reference = [np.roll(base, (i % 2, i % 3), (0, 1)) for i in range(6)]
    assert min(np.abs(got.data[0][inner] - r[inner]).mean() for r in reference) < 0.02
    assert (folder / "out.tif").exists() and (folder / "out.jpg").read_bytes()[:2] == b"\xff\xd8"
    assert "polyline" in (folder / "out.html").read_text()


def test_stretch_and_rgb_jobs(spark, folder):
    presets.pipeline("stretch", {"out": "s.fits", "jpg": "", "starSig": 10.0, "starRadius": 8, "alignK": 6, "autoScale": 2.0}, ["light0.fits"]).run(state(spark, folder))
    out = fits.parse((folder / "s.fits").read_bytes()).data[0]
    assert 0 <= out.min() and out.max() <= 1.001
    presets.pipeline("rgb", {"out": "c.fits", "starSig": 10.0, "starRadius": 8, "chromaGamma": 1.5, "scnr": 0.3, "balBlock": 8, "autoScale": 2.0}, ["light0.fits", "light0.fits", "light0.fits"][:1] + ["light3.fits", "light1.fits"]).run(state(spark, folder))
    c = fits.parse((folder / "c.fits").read_bytes())
    assert c.data.shape[0] == 3 and np.isfinite(c.data).all()


def test_command_line():
    args = cli.parser().parse_intermixed_args(["stack", "-stMode", "2", "a.fits", "-dark", "d.fits", "b.fits"])
    assert args.stMode == 2 and args.files == ["a.fits", "b.fits"] and args.dark == "d.fits"
    assert cli.main(["version"]) == 0 and cli.main(["legal"]) == 0
    with pytest.raises(ValueError):
        presets.pipeline("stack", {"nope": 1}, [])


def test_http_front_end(spark, folder):
    import threading
    import urllib.error
    import urllib.request
    from http.server import ThreadingHTTPServer

    from frameloom import rest

    server = ThreadingHTTPServer(("127.0.0.1", 0), rest.handler(spark, str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert b"pong" in urllib.request.urlopen(f"{at}/api/v1/ping").read()
        assert "light0.fits" in json.loads(urllib.request.urlopen(f"{at}/api/v1/files/").read())
        doc = {"type": "seq", "steps": [{"type": "load", "fileName": "light0.fits"}, {"type": "save", "filePattern": "copy%d.fits"}]}
        body = urllib.request.urlopen(urllib.request.Request(f"{at}/api/v1/job", json.dumps(doc).encode())).read()
        assert body.strip().endswith(b"done") and os.path.exists(folder / "copy0.fits")
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(f"{at}/api/v1/job", b'{"type": "x"}'))
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/api/v1/files/../../etc/passwd")
    finally:
        server.shutdown()


def test_headers_are_read_alone_and_files_written_by_tasks(spark, tmp_path):
    data = np.random.default_rng(4).random((1, 300, 400)).astype(np.float32)
    raw = fits.encode(fits.Image(data, fits.Header(strings={"NOTE": "y" * 3000}), exposure=7.0))
    (tmp_path / "a.fits").write_bytes(raw)
    (tmp_path / "b.fits.gz").write_bytes(gzip.compress(raw))
    for name in ("a.fits", "b.fits.gz"):
        got = fits.head(f"file:{tmp_path}/{name}")
        assert raw.startswith(got) and len(got) < 10_000 and fits.parse(got, False).exposure == 7.0
    rows = fits.frames(spark, ["*.fits*"], f"file://{tmp_path}").collect()
    assert [(r.width, r.height, r.exposure) for r in rows] == [(400, 300, 7.0)] * 2
    content = spark.createDataFrame([(i, bytes([i]) * 10) for i in range(5)], "frame_id int, content binary")
    for _ in range(2):
        fits.written(content, f"file://{tmp_path}/deep/out", lambda i: f"f{i}.bin")
    assert sorted(p.name for p in (tmp_path / "deep/out").iterdir()) == [f"f{i}.bin" for i in range(5)]
    assert (tmp_path / "deep/out/f3.bin").read_bytes() == b"\3" * 10
    assert fits.file_system("nosuch://x/y") is None


@pytest.mark.parametrize("flag", ["-chroot=/x", "-setuid=5", "-stMemory=100"])
def test_flags_without_a_meaning_are_refused(flag):
    with pytest.raises(SystemExit, match="not supported"):
        cli.main(["version", *flag.split("=")])


def test_profiles_are_written(tmp_path, capsys):
    assert cli.main(["version", "-cpuprofile", str(tmp_path / "cpu"), "-memprofile", str(tmp_path / "mem")]) == 0
    assert (tmp_path / "cpu").stat().st_size and (tmp_path / "mem").stat().st_size
