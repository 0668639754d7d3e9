import numpy as np

from cloudgauge.operators import nearest
from cloudgauge.operators.kd import kd_squared_distance
from cloudgauge.plans.cli import main
from tests.test_ply import header
from tests.test_project import EYE, mesh

SCAN = np.array([[1, 0, 0], [0, 2, 0], [0, 0, 3]], "<f4")


def scene(tmp_path, recon=SCAN, matrix=EYE):
    (tmp_path / "s.ply").write_bytes(header(count=len(SCAN)) + SCAN.tobytes())
    (tmp_path / "r.ply").write_bytes(header(count=len(recon)) + recon.tobytes())
    (tmp_path / "p.mlp").write_text(f"<MeshLabProject><MeshGroup>{mesh('s.ply', matrix=matrix)}</MeshGroup></MeshLabProject>")
    return ["--reconstruction_ply_path", str(tmp_path / "r.ply"), "--ground_truth_mlp_path", str(tmp_path / "p.mlp"), "--tolerances", "0.1,0.01"]


def test_perfect_reconstruction(spark, tmp_path, capsys):
    out = tmp_path / "deep" / "c"
    args = [*scene(tmp_path), "--completeness_cloud_output_path", str(out), "--accuracy_cloud_output_path", str(tmp_path / "a"), "--nn_verify"]
    assert main(args, spark) == 0
    text = capsys.readouterr().out
    assert text.splitlines()[-4:] == ["Tolerances: 0.01 0.1", "Completenesses: 1 1", "Accuracies: 1 1", "F1-scores: 1 1"]
    assert text.index("Loading reconstruction:") < text.index("Loading scan:") < text.index("Computing completeness") < text.index("Computing accuracy")
    for name in ("deep/c.tolerance_0.01.ply", "deep/c.tolerance_0.1.ply", "a.tolerance_0.01.ply", "a.tolerance_0.1.ply"):
        assert (tmp_path / name).exists()


def test_exit_codes(spark, tmp_path):
    args = scene(tmp_path)
    assert main([*args[:4]], spark) == 1 and main([*args, "--voxel_size", "0"], spark) == 1
    assert main([*scene(tmp_path, matrix=EYE.replace("0 0 0 1", "0 0 0 2"))], spark) == 1
    args = scene(tmp_path)
    (tmp_path / "s.ply").write_bytes(b"ply\nformat ascii 1.0\n")
    assert main(args, spark) == 3
    (tmp_path / "s.ply").unlink()
    assert main(args, spark) == 1
    (tmp_path / "r.ply").unlink()
    assert main(args, spark) == 2


def test_a_difference_between_the_indexes_fails_before_anything_is_written(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(nearest, "kd_squared_distance", lambda q, c, r: kd_squared_distance(q, c.limit(0), r))
    args = [*scene(tmp_path), "--completeness_cloud_output_path", str(tmp_path / "c"), "--nn_verify"]
    assert main(args, spark) == 1
    assert "'queries': 3, 'value_mismatches': 3, 'band_mismatches': 3" in capsys.readouterr().err
    assert not list(tmp_path.glob("c.*"))
