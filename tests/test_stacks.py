"""The image stack source on files made by hand, its pushed filters, and what it writes."""

import os
import struct
import zlib

import numpy as np
import pytest

from stackweave.sources import stacks


def tiff(pages, order="<", tile=None, rows=3, packed=False, predictor=1, wide=False):
    """Pages of one dtype; strips of ``rows`` rows or square tiles."""
    mark, offset, entry = (43, "Q", "HHQ") if wide else (42, "I", "HHI")
    head = struct.pack(order + "2sHHHQ", b"", 43, 8, 0, 0) if wide else struct.pack(order + "2sHI", b"", mark, 0)
    out = bytearray((b"II" if order == "<" else b"MM") + head[2:])
    link = 8 if wide else 4
    for px in pages:
        ny, nx = px.shape
        blocks = [px[y : y + tile, x : x + tile] for y in range(0, ny, tile) for x in range(0, nx, tile)] if tile else [px[y : y + rows] for y in range(0, ny, rows)]
        starts, sizes = [], []
        for b in blocks:
            if tile:
                b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1])))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=b.dtype.type(0))
            raw = b.astype(b.dtype.newbyteorder(order)).tobytes()
            raw = zlib.compress(raw) if packed else raw
            starts.append(len(out))
            sizes.append(len(raw))
            out += raw
        code = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
        tags = [(256, [nx]), (257, [ny]), (258, [px.dtype.itemsize * 8]), (259, [8 if packed else 1]), (277, [1]), (317, [predictor]), (339, [code])]
        tags += [(322, [tile]), (323, [tile]), (324, starts), (325, sizes)] if tile else [(273, starts), (278, [rows]), (279, sizes)]
        kind, letter = (16, "Q") if wide else (4, "I")
        entries, held = [], struct.calcsize(letter)
        for tag, values in sorted(tags):
            if len(values) == 1:
                value = values[0]
            else:
                value = len(out)
                out += struct.pack(f"{order}{len(values)}{letter}", *values)
            entries.append(struct.pack(order + entry + offset, tag, kind, len(values), value))
        out[link : link + held] = struct.pack(order + offset, len(out))
        out += struct.pack(order + ("Q" if wide else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(held)
    return bytes(out)


def dm(version, images, voltage=300000.0):
    """A file of images, each (px, scale): nested groups of named and unnamed tags."""
    word = ">q" if version == 4 else ">i"
    n = lambda v: struct.pack(word, v)

    def tag(name, body, kind):
        name = name.encode()
        return struct.pack(">BH", kind, len(name)) + name + (n(len(body)) if version == 4 else b"") + body

    def data(name, info, raw):
        return tag(name, b"%%%%" + n(len(info)) + b"".join(map(n, info)) + raw, 21)

    def group(name, *tags):
        return tag(name, bytes(2) + n(len(tags)) + b"".join(tags), 20)

    def image(px, scale):
        code = {"i2": 2, "u2": 4, "f4": 6, "i4": 3}[px.dtype.str[1:]]
        dims = [data("", [5], struct.pack("<I", d)) for d in px.shape[::-1]]
        calibration = group("Calibrations", group("Dimension", group("", data("Scale", [6], struct.pack("<f", scale)), data("Units", [20, 4, 2], "nm".encode("utf-16-le")))))
        body = group("ImageData", calibration, data("Data", [20, code, px.size], px.tobytes()), group("Dimensions", *dims))
        scope = group("Microscope Info", data("Voltage", [7], struct.pack("<d", voltage)), data("Cs(mm)", [7], struct.pack("<d", 2.7)), data("Odd", [15, 0, 2, 0, 3, 0, 7], struct.pack("<id", 1, 2.0)), data("Name", [18, 4], "ab".encode("utf-16-le")))
        device = group("Acquisition", group("Device", group("CCD", data("Pixel Size (um)", [15, 0, 2, 0, 6, 0, 6], struct.pack("<2f", 5.0, 5.0)), data("Rects", [20, 15, 0, 2, 0, 3, 0, 3, 4], bytes(32)))))
        return group("", body, group("ImageTags", scope, device))

    tags = [data("Before", [8], b"\1"), group("ImageList", *(image(*i) for i in images)), data("After", [3], struct.pack("<i", 7))]
    root = bytes(2) + n(len(tags)) + b"".join(tags)
    return struct.pack(">I", version) + n(len(root)) + struct.pack(">I", 1) + root


def put(path, raw):
    with open(path, "wb") as f:
        f.write(raw)


def pixels(rows):
    return {(os.path.basename(r.path), r.frame): (r.ny, r.nx, np.array(r.px)) for r in rows}


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "i4", "f4"])
def test_tiff_pages(dtype, order, tmp_path):
    rng = np.random.default_rng(0)
    want = rng.integers(0, 120, (4, 7, 10)).astype(dtype)
    kinds = [dict(), dict(packed=True), dict(tile=4), dict(tile=4, packed=True), dict(wide=True)] + ([dict(predictor=2, packed=True), dict(predictor=2, tile=16)] if dtype != "f4" else [])
    for k, kind in enumerate(kinds):
        put(tmp_path / f"{k}.tif", tiff(list(want), order, **kind))
        with open(tmp_path / f"{k}.tif", "rb") as f:
            s = stacks.open_tiff(f, 0)
            assert (s.ny, s.nx, s.count) == (7, 10, 4)
            for page in (2, 0, 3, 1):
                assert (s.read(f, page).reshape(7, 10) == want[page]).all(), kind


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("shape", [(3, 40, 50), (4, 5), (2, 4, 5)])
def test_dm_files(version, shape, tmp_path):
    want = np.random.default_rng(1).integers(-500, 500, shape).astype("<i2")
    put(tmp_path / "a.dm", dm(version, [(np.zeros((64, 64), "<i4"), 9.0), (want, 0.25)]))
    with open(tmp_path / "a.dm", "rb") as f:
        s = stacks.open_dm(f, 0)
        assert (s.ny, s.nx, s.count) == (*shape[-2:], shape[0] if len(shape) == 3 else 1)
        assert s.meta == {"pixelsize": 0.25, "voltage": 300.0, "c3": 2.7, "detector_pixel": 5.0}
        for k in range(s.count):
            assert (s.read(f, k) == want.reshape(s.count, -1)[k]).all()


def test_all_formats_under_one_folder(spark, tmp_path):
    rng = np.random.default_rng(2)
    frames = rng.integers(0, 1000, (5, 6, 8)).astype("<i2")
    put(tmp_path / "a.tif", tiff(list(frames)))
    put(tmp_path / "b.dm4", dm(4, [(frames, 0.5)], 0.0))
    put(tmp_path / "c.DM3", dm(3, [(frames[0], 0.5)]))
    put(tmp_path / "notes.txt", b"not an image")
    df = stacks.read_stacks(spark, str(tmp_path))
    got = pixels(df.collect())
    assert set(got) == {("a.tif", k) for k in range(5)} | {("b.dm4", k) for k in range(5)} | {("c.DM3", 0)}
    assert all((v[2] == frames[k[1]].ravel()).all() and v[:2] == (6, 8) for k, v in got.items())
    assert {(r.pixelsize, r.voltage) for r in df.collect() if r.path.endswith("dm4")} == {(0.5, None)}
    bare = stacks.read_stacks(spark, str(tmp_path), pixels=False)
    assert "px" not in bare.columns and bare.count() == 11
    put(tmp_path / "d.tif", b"II*\0")
    with pytest.raises(Exception, match="d.tif"):
        df.count()


@pytest.mark.parametrize("form", ["mrc", "tif"])
def test_written_stacks_come_back(spark, tmp_path, form):
    rng = np.random.default_rng(3)
    px = {(s, k): rng.normal(size=12).astype("f4") for s in ("p", "q") for k in range(9)}
    frames = spark.createDataFrame([(s, k, v.tolist()) for (s, k), v in px.items()], "stack_id string, frame int, px array<float>").repartition(5)
    wrote = {r.stack_id: r for r in stacks.write_stacks(frames, str(tmp_path / "out"), 3, 4, form, 0.5).collect()}
    assert {k: r.frames for k, r in wrote.items()} == {"p": 9, "q": 9}
    got = pixels(stacks.read_stacks(spark, str(tmp_path / "out"), rangeBytes=100).collect())
    assert {(k[0][0], k[1]) for k in got} == set(px) and all((v[2] == px[k[0][0], k[1]]).all() for k, v in got.items())
    assert sorted(os.listdir(tmp_path / "out")) == [f"p.{form}", f"q.{form}"]


def test_filters_open_only_what_they_name(spark, tmp_path, monkeypatch):
    frames = spark.createDataFrame([(s, k, [float(k)] * 12) for s in "pqr" for k in range(40)], "stack_id string, frame int, px array<float>")
    stacks.write_stacks(frames, str(tmp_path), 3, 4).collect()
    df = stacks.read_stacks(spark, str(tmp_path), rangeBytes=480)  # ten frames a range
    assert df.filter("frame between 12 and 17").rdd.getNumPartitions() == 3
    one = df.filter(f"frame in (3, 25) and path = 'file://{tmp_path}/q.mrc'")
    assert one.rdd.getNumPartitions() == 2 and sorted(r.frame for r in one.collect()) == [3, 25]
    assert df.filter("frame > 5 and frame <= 8 and ny = 3").count() == 9
    assert df.filter("frame = 3 and frame = 4").count() == 0
    assert df.count() == 120
    # what a task reads: only the named frames' bytes
    reader = stacks.StackReader({"path": str(tmp_path), "rangebytes": "480"})
    assert not list(reader.pushFilters([stacks.EqualTo(("frame",), 31)]))
    read = []
    monkeypatch.setattr(stacks, "at", lambda f, start, n: read.append((start, n)) or b"\0" * n)
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(list(reader.read(p))) for p in parts) == 3 and read == [(1024 + 31 * 48, 48)] * 3


def test_a_sequence_counts_by_number(spark, tmp_path):
    for k in (2, 10, 1, 33):
        put(tmp_path / f"run{k}.dm3", dm(3, [(np.full((4, 5), k, "<i2"), 0.5)]))
    got = stacks.as_sequence(stacks.read_stacks(spark, str(tmp_path))).collect()
    assert {r.stack_id.rsplit("/", 1)[-1] for r in got} == {"run.dm3"}
    assert {r.frame: r.px[0] for r in got} == {0: 1.0, 1: 2.0, 2: 10.0, 3: 33.0}


def h5(nodes, chunk=None, packed=False, big=False):
    """A file with the arrays of ``nodes`` under its root; 3-D ones in chunks if ``chunk`` is given, others contiguous."""
    out = bytearray(96)

    def put_at_end(raw):
        out.extend(bytes(-len(out) % 8))
        out.extend(raw)
        return len(out) - len(raw)

    def message(kind, body):
        body += bytes(-len(body) % 8)
        return struct.pack("<HHB3x", kind, len(body), 0) + body

    def header(*found, cut=0):
        """``cut`` messages lie in the header, the rest in a continued block."""
        rest = b"".join(found[cut:]) if cut else b""
        own = list(found[:cut] if cut else found)
        if rest:
            own.append(message(0x10, struct.pack("<QQ", put_at_end(rest), len(rest))))
        body = b"".join(own)
        return put_at_end(struct.pack("<BxHII4x", 1, len(found), 1, len(body)) + body)

    def dataset(a):
        order = ">" if big else "<"
        raw = a.astype(a.dtype.newbyteorder(order))
        code = {"f": 0x11, "i": 0x10, "u": 0x10}[a.dtype.kind]
        kind = struct.pack("<BBBBI", code, big | (8 if a.dtype.kind == "i" else 0), 0, 0, a.dtype.itemsize) + bytes(12)
        space = struct.pack(f"<BBB5x{a.ndim}Q", 1, a.ndim, 0, *a.shape)
        found = [message(0x01, space), message(0x03, kind)]
        if chunk and a.ndim == 3:
            keys = []
            for corner in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunk))):
                corner = [k * c for k, c in zip(corner, chunk)]
                block = raw[tuple(slice(k, k + c) for k, c in zip(corner, chunk))]
                block = np.pad(block, [(0, c - s) for c, s in zip(chunk, block.shape)]).astype(raw.dtype)
                data = block.tobytes()
                if packed:
                    data = zlib.compress(np.frombuffer(data, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
                keys.append((struct.pack("<II4Q", len(data), 0, *corner, 0), put_at_end(data)))
            end = struct.pack("<II4Q", 0, 0, *a.shape, 0)
            node = lambda level, some: b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), 2**64 - 1, 2**64 - 1) + b"".join(k + struct.pack("<Q", v) for k, v in some) + end
            leaves = [keys[k : k + 3] for k in range(0, len(keys), 3)]  # several leaves below one root
            root = put_at_end(node(1, [(some[0][0], put_at_end(node(0, some))) for some in leaves]))
            found.append(message(0x08, struct.pack("<BBBQ4I", 3, 2, 4, root, *chunk, a.dtype.itemsize)))
            if packed:
                found.append(message(0x0B, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHH8sII", 2, 8, 0, 1, b"shuffle", a.dtype.itemsize, 0) + struct.pack("<HHHH8sII", 1, 8, 0, 1, b"deflate", 6, 0)))
        elif a.size < 4:
            found.append(message(0x08, struct.pack("<BBH", 3, 0, raw.nbytes) + raw.tobytes()))
        else:
            found.append(message(0x08, struct.pack("<BBQQ", 3, 1, put_at_end(raw.tobytes()), raw.nbytes)))
        return header(*found, cut=2)

    names = bytearray(8)
    entries = []
    for name, a in sorted(nodes.items()):
        entries.append(struct.pack("<QQII16x", len(names), dataset(np.asarray(a)), 0, 0))
        names += name.encode() + bytes(8 - len(name) % 8)
    heap = put_at_end(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 2**64 - 1, put_at_end(bytes(names))))
    leaf = put_at_end(b"SNOD" + struct.pack("<BBH", 1, 0, len(entries)) + b"".join(entries))
    root = put_at_end(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 2**64 - 1, 2**64 - 1) + struct.pack("<QQQ", 0, leaf, 8))
    group = header(message(0x11, struct.pack("<QQ", root, heap)))
    out[:96] = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI4Q", 4, 16, 0, 0, 2**64 - 1, len(out), 2**64 - 1) + struct.pack("<QQII16x", 0, group, 0, 0)
    return bytes(out)


@pytest.mark.parametrize("dtype", ["u1", "i2", "i4", "f4", "f8"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("chunk,packed", [(None, False), ((2, 3, 4), False), ((3, 5, 4), True), ((1, 7, 10), True)])
def test_hdf5_arrays(dtype, big, chunk, packed, tmp_path):
    want = np.random.default_rng(5).integers(0, 120, (5, 7, 10)).astype(dtype)
    put(tmp_path / "a.h5", h5({"images": want, "pixelsize": np.array([0.25]), "C3": np.array([2.7], "f4"), "voltage": np.array(300.0)}, chunk, packed, big))
    with open(tmp_path / "a.h5", "rb") as f:
        s = stacks.open_hdf5(f, 0)
        assert (s.ny, s.nx, s.count) == (7, 10, 5)
        assert s.meta["pixelsize"] == 0.25 and abs(s.meta["c3"] - 2.7) < 1e-6 and s.meta["voltage"] == 300.0 and s.meta["detector_pixel"] is None
        for k in (4, 0, 3, 1, 2):
            assert (s.read(f, k).reshape(7, 10) == want[k]).all()


def test_hdf5_of_other_contents(tmp_path):
    flat = np.arange(70.0).reshape(7, 10)
    put(tmp_path / "a.h5", h5({"images": flat}))
    with open(tmp_path / "a.h5", "rb") as f:
        s = stacks.open_hdf5(f, 0)
        assert s.count == 1 and (s.read(f, 0) == flat.ravel()).all()
    for raw, said in ((h5({"other": flat}), "no node /images"), (h5({"images": np.arange(9.0)}), "1 axes"), (b"\x89HDF" + bytes(60), "superblock")):
        put(tmp_path / "b.h5", raw)
        with open(tmp_path / "b.h5", "rb") as f, pytest.raises(ValueError, match=said):
            stacks.open_hdf5(f, 0)
