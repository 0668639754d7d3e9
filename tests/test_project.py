import pytest

from cloudgauge.sources.project import ProjectError, check_poses, read_project, read_projects, resolved

EYE = "1 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1"


def mesh(name="a.ply", label='label="a"', matrix=EYE):
    return f"<MLMesh {label} filename=\"{name}\"><MLMatrix44>{matrix}</MLMatrix44></MLMesh>"


def write(tmp_path, body, root="MeshLabProject", head="<!DOCTYPE MeshLabDocument>"):
    path = tmp_path / "p.mlp"
    path.write_text(f"{head}<{root}>{body}</{root}>")
    return str(path)


def test_reads_the_first_group_in_order(tmp_path, capsys):
    path = write(tmp_path, f"<MeshGroup>{mesh()}{mesh('b.ply', '')}</MeshGroup><MeshGroup>{mesh('c.ply')}</MeshGroup>")
    scans = read_project(path)
    assert [(s.scan_id, s.filename, s.label) for s in scans] == [(0, "a.ply", "a"), (1, "b.ply", None)]
    assert "no label" in capsys.readouterr().err
    check_poses(scans)


def test_no_meshes_is_fine(tmp_path):
    assert read_project(write(tmp_path, "<MeshGroup/>")) == []


@pytest.mark.parametrize("body,root", [("", "MeshLabProject"), (f"<MeshGroup>{mesh()}</MeshGroup>", "Other"), ("<MeshGroup><MLMesh filename='a'/></MeshGroup>", "MeshLabProject"), (f"<MeshGroup><MLMesh><MLMatrix44>{EYE}</MLMatrix44></MLMesh></MeshGroup>", "MeshLabProject"), (f"<MeshGroup>{mesh(matrix='1 0 0')}</MeshGroup>", "MeshLabProject"), (f"<MeshGroup>{mesh(matrix='')}</MeshGroup>", "MeshLabProject")])
def test_faults(tmp_path, body, root):
    with pytest.raises(ProjectError):
        read_project(write(tmp_path, body, root))


def test_empty_and_missing(tmp_path):
    (tmp_path / "e.mlp").write_text("")
    for name in ("e.mlp", "none.mlp"):
        with pytest.raises(ProjectError):
            read_project(str(tmp_path / name))


def test_last_row(tmp_path):
    with pytest.raises(ProjectError):
        check_poses(read_project(write(tmp_path, f"<MeshGroup>{mesh(matrix=EYE.replace('0 0 0 1', '0 0 1 1'))}</MeshGroup>")))


def test_paths():
    assert resolved("/d/p.mlp", "a.ply") == "/d/a.ply" and resolved("/d/p.mlp", "/a.ply") == "/a.ply" and resolved("/d/p.mlp", "") == ""


def test_source_reads_all_projects_of_a_folder(spark, tmp_path):
    for name, body in (("a", f"<MeshGroup>{mesh()}{mesh('/abs/b.ply')}</MeshGroup>"), ("deep/b", f"<MeshGroup>{mesh('c.ply', 'label=\"c\"', EYE.replace('1 0 0 0', '1 0 0 2.5', 1))}</MeshGroup>"), ("none", "<MeshGroup/>")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.mlp").write_text(f"<MeshLabProject>{body}</MeshLabProject>")
    (tmp_path / "other.xml").write_text("no project")
    found = read_projects(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    got = sorted((r["project"], r["scan_id"], r["label"], r["path"], r["pose"][3]) for r in found.collect())
    assert got == [(f"{tmp_path}/a.mlp", 0, "a", f"{tmp_path}/a.ply", 0.0), (f"{tmp_path}/a.mlp", 1, "a", "/abs/b.ply", 0.0), (f"{tmp_path}/deep/b.mlp", 0, "c", f"{tmp_path}/deep/c.ply", 2.5)]
    assert [r["scan_id"] for r in read_projects(spark, f"file://{tmp_path}/a.mlp").orderBy("scan_id").collect()] == [0, 1]


@pytest.mark.parametrize("body, message", [("<MeshGroup><MLMesh filename='a'/></MeshGroup>", "no filename or no MLMatrix44"), (f"<MeshGroup>{mesh(matrix=EYE.replace('0 0 0 1', '0 0 0 2'))}</MeshGroup>", "last row")])
def test_source_refuses_faulty_projects(spark, tmp_path, body, message):
    path = write(tmp_path, body)
    with pytest.raises(Exception, match=message):
        read_projects(spark, path).collect()
