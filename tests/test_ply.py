import numpy as np
import pytest

from cloudgauge.sources.ply import PlySource, PlyUnreadable, PlyUnsupported, coloured_header, is_dense, parse_header, read_cloud, write_clouds, write_coloured

FLOATS = "property float x\nproperty float y\nproperty float z\n"


def header(vertex=FLOATS, count=3, after="", before="", form="format binary_little_endian 1.0\n"):
    return f"ply\n{form}comment made here\n{before}element vertex {count}\n{vertex}{after}end_header\n".encode()


XYZ = np.arange(9, dtype="<f4").reshape(3, 3)


def write(tmp_path, data, name="c.ply"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def rows(spark, path, **options):
    return [tuple(r) for r in read_cloud(spark, path, **options).orderBy("point_index").collect()]


WANT = [(k, *map(float, XYZ[k])) for k in range(3)]


@pytest.mark.parametrize("after,tail", [("", b""), ("", b"junk"), ("element face 2\nproperty list uchar int vertex_indices\n", b"\0" * 26), ("element camera 1\nproperty float a\n", b"\0" * 4)])
def test_plain(spark, tmp_path, after, tail):
    assert rows(spark, write(tmp_path, header(after=after) + XYZ.tobytes() + tail)) == WANT


def test_crlf(spark, tmp_path):
    assert rows(spark, write(tmp_path, header().replace(b"\n", b"\r\n") + XYZ.tobytes())) == WANT


def test_other_properties(spark, tmp_path):
    kind = np.dtype([("c", "u1"), ("z", "<f4"), ("q", "<f8"), ("x", "<f4"), ("s", "<i2"), ("y", "<f4")])
    data = np.zeros(3, kind)
    for k, c in enumerate("xyz"):
        data[c] = XYZ[:, k]
    text = "property uchar c\nproperty float z\nproperty double q\nproperty float x\nproperty short s\nproperty float y\n"
    assert rows(spark, write(tmp_path, header(text) + data.tobytes())) == WANT


def test_missing_coordinate_is_zero(spark, tmp_path):
    assert rows(spark, write(tmp_path, header("property float x\nproperty float y\n", 2) + XYZ[:2, :2].tobytes())) == [(0, 0.0, 1.0, 0.0), (1, 3.0, 4.0, 0.0)]


def test_bits_are_kept_and_density(spark, tmp_path):
    odd = np.array([[np.nan, 0, 0], [np.inf, -np.inf, -0.0]], "<f4")
    path = write(tmp_path, header(count=2) + odd.tobytes())
    got = np.array([r[1:] for r in rows(spark, path)], "<f4")
    assert np.array_equal(np.isnan(got), np.isnan(odd)) and got[1].tobytes() == odd[1].tobytes()
    assert not is_dense(spark, path) and is_dense(spark, write(tmp_path, header() + XYZ.tobytes(), "d.ply"))
    normals = np.zeros(1, [(n, "<f4") for n in ("x", "y", "z", "nx")])
    normals["nx"] = np.nan
    assert not is_dense(spark, write(tmp_path, header(FLOATS + "property float nx\n", 1) + normals.tobytes(), "n.ply"))


def test_no_vertices(spark, tmp_path):
    assert rows(spark, write(tmp_path, header(count=0))) == []


def test_many_partitions(spark, tmp_path, monkeypatch):
    data = np.random.default_rng(0).normal(size=(1000, 3)).astype("<f4")
    path = write(tmp_path, header(count=1000) + data.tobytes())
    got = read_cloud(spark, path).toPandas().sort_values("point_index")
    assert np.array_equal(got[["x", "y", "z"]].to_numpy(), data)


@pytest.mark.parametrize(
    "bad",
    [
        header(form="format ascii 1.0\n"), header(form="format binary_big_endian 1.0\n"), header(form=""), header(form="format binary_little_endian 1.0\n" * 2),
        header(FLOATS.replace("float", "double")), header(FLOATS + "property list uchar int i\n"), header(FLOATS + "property float x\n"), header(before="obj_info hi\n"),
        header(before="element range_grid 2\nproperty float r\n"), header(after="element range_grid 2\nproperty float r\n"), header(after="element vertex 1\nproperty float x\n"),
        header(before="\n"), header(before="nonsense\n"), header("".join(f"property double p{k}\n" for k in range(600)) + FLOATS), header(count="-1"), header(count=2**32), b"plx\n", b"ply\n" + b"comment x\n" * 9000,
        header(after="element face 1\nproperty list uchar int\n"), header().replace(b"end_header", b"end_header now"),
    ],
)
def test_unsupported(bad):
    with pytest.raises(PlyUnsupported):
        parse_header(bad)


def test_types_after_the_vertices_do_not_matter():
    assert parse_header(header(after="element face 1\nproperty list odd odder vertex_indices\nelement camera 1\nproperty strange p\n")).count == 3


def test_empty_elements_are_accepted():
    assert parse_header(header(before="element odd 0\nproperty float r\n")).count == 3


def test_unreadable(spark, tmp_path):
    with pytest.raises(PlyUnreadable):
        read_cloud(spark, str(tmp_path / "none.ply"))
    with pytest.raises(PlyUnreadable):
        read_cloud(spark, write(tmp_path, header() + XYZ.tobytes()[:-1]))


def test_general_variants(spark, tmp_path):
    text = header(form="format ascii 1.0\n") + "\n".join(" ".join(map(str, r)) for r in XYZ).encode()
    assert rows(spark, write(tmp_path, text, "a.ply"), general=True) == WANT
    big = header(FLOATS.replace("float", "double"), form="format binary_big_endian 1.0\n") + XYZ.astype(">f8").tobytes()
    assert rows(spark, write(tmp_path, big, "b.ply"), general=True) == WANT


def test_round_trip(spark, tmp_path):
    cloud = spark.createDataFrame([(2, 1.0, float("nan"), -0.0, 255, 0, 7), (1, 4.0, 5.0, 6.0, 0, 255, 0)], "point_index long, x float, y float, z float, red short, green short, blue short")
    path = str(tmp_path / "out.ply")
    assert write_coloured(cloud, path)
    data = open(path, "rb").read()
    assert data.startswith(coloured_header(2)) and len(data) == len(coloured_header(2)) + 2 * 15 + 84
    got = rows(spark, path)
    assert got[0] == (0, 4.0, 5.0, 6.0) and got[1][1] == 1.0 and np.isnan(got[1][2])
    assert data[len(coloured_header(2)) + 12 :][:3] == bytes([0, 255, 0])
    colours = [tuple(r)[4:] for r in read_cloud(spark, path, colours=True).orderBy("point_index").collect()]
    assert colours == [(0, 255, 0), (255, 0, 7)]
    assert not write_coloured(cloud.limit(0), str(tmp_path / "empty.ply")) and not (tmp_path / "empty.ply").exists()


def test_large_cloud_is_written_in_order(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(20_000, 3)).astype("f4")
    order = rng.permutation(len(xyz))
    cloud = spark.createDataFrame([(int(k), *map(float, xyz[k]), int(k) % 256, 0, 1) for k in order], "point_index long, x float, y float, z float, red int, green int, blue int").repartition(7)
    path = str(tmp_path / "large.ply")
    assert write_coloured(cloud, path) and is_dense(spark, path)
    got = read_cloud(spark, path, colours=True).toPandas().sort_values("point_index")
    assert np.array_equal(got[["x", "y", "z"]].to_numpy(), xyz) and (got["red"] == got["point_index"] % 256).all() and (got["blue"] == 1).all()


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from cloudgauge.sources.files import shared_base

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_base(SimpleNamespace(sparkContext=context))


@pytest.mark.parametrize("fault", ["before", "within"])
def test_failed_task_leaves_no_file(spark, tmp_path, fault):
    z = "CAST(IF(id = 700, raise_error('faulty row'), 1) AS FLOAT)" if fault == "before" else "1f"
    colours = [f"0S AS {c}_{k}" for k in range(2 if fault == "before" else 1) for c in ("red", "green", "blue")]  # a set too few: the writer fails when its files are open
    cloud = spark.range(1000).selectExpr("CAST(id AS FLOAT) AS x", "CAST(id AS FLOAT) AS y", f"{z} AS z", *colours).repartition(4)
    spark.dataSource.register(PlySource)
    with pytest.raises(Exception, match="faulty row|red_1"):
        cloud.write.format("ply").mode("overwrite").option("names", '[".a", ".b"]').save(str(tmp_path / "bad"))
    assert list(tmp_path.iterdir()) == []


def test_sink_replaces_and_makes_folders(spark, tmp_path):
    cloud = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1, 2, 3)], "point_index long, x float, y float, z float, red short, green short, blue short")
    path = f"file://{tmp_path}/a/b/out.ply"
    for rows in (cloud, cloud.union(cloud)):
        assert write_coloured(rows, path)
        assert read_cloud(spark, path).count() == rows.count()
    assert not write_coloured(cloud.limit(0), path)  # nor is the earlier file left
    assert sorted(p.name for p in (tmp_path / "a" / "b").iterdir()) == []
    with pytest.raises(Exception, match="whole"):
        cloud.write.format("ply").mode("append").save(path)


def test_one_pass_writes_all_sets_of_colours(spark, tmp_path):
    names = [f".t{k}" for k in range(4)]
    cloud = spark.range(5000).selectExpr("id", "CAST(id AS FLOAT) AS x", "0f AS y", "1f AS z", *(f"CAST((id + {k}) % 256 AS SHORT) AS {c}_{k}" for k in range(4) for c in ("red", "green", "blue"))).repartition(5)
    paths = write_clouds(cloud, str(tmp_path / "c"), names, "id")
    assert paths == [str(tmp_path / f"c{n}") for n in names]
    for k, path in enumerate(paths):
        got = read_cloud(spark, path, colours=True).toPandas().sort_values("point_index")
        assert (got["x"] == got["point_index"]).all() and (got["red"] == (got["point_index"] + k) % 256).all() and len(got) == 5000


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_ascii_ranges_equal_the_whole(spark, tmp_path, monkeypatch, split):
    from cloudgauge.sources import ply

    monkeypatch.setattr(ply, "ASCII_SPLIT", split)
    rng = np.random.default_rng(split)
    number = 40 if split == 7 else 300
    xyz = rng.normal(size=(number, 4)).astype("f4")
    words = [repr(float(v)) for v in xyz.ravel()]
    text = "".join(w + [" ", "\n", "  ", "\r\n", " \t "][rng.integers(5)] for w in words)
    form = header(FLOATS + "property float q\n", number, form="format ascii 1.0\n")
    path = write(tmp_path, form + text.rstrip().encode() + (b" 1 2 3" if split == 64 else b""), "a.ply")
    cloud = read_cloud(spark, path, general=True)
    assert cloud.rdd.getNumPartitions() == max(1, -(-(len(text.rstrip()) + 6 * (split == 64)) // split))
    assert [tuple(r) for r in cloud.orderBy("point_index").collect()] == [(k, *map(float, xyz[k, :3])) for k in range(number)]
    with pytest.raises((PlyUnreadable, Exception), match="ends before"):
        read_cloud(spark, write(tmp_path, form + text.rsplit(None, 2)[0].encode(), "b.ply"), general=True).collect()
