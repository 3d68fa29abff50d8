import pytest

from keystrand import cli
from keystrand.settings import Settings


@pytest.fixture
def here(spark, monkeypatch):
    from keystrand.sources.recordfile import register

    register(spark)
    monkeypatch.setattr(cli, "session", lambda *_: spark)


def test_generate_sort_check_diff(here, tmp_path, capsys):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert cli.main(["gen", "-s", "300", "-r", "20", path]) == 0
    assert cli.main(["check", path]) == 1
    assert cli.main(["sort", "-o", out, "--single", f"{out}.dat", path]) == 0
    assert "# elapsed time (keystrand): " in capsys.readouterr().out
    assert cli.main(["check", out]) == 0
    assert cli.main(["check", f"{out}.dat"]) == 0
    assert cli.main(["diff", out, f"{out}.dat"]) == 0
    assert cli.main(["diff", out, path]) == 1
    assert cli.main(["runs", "-m", "2000", path]) == 0
    assert "replacement_selection" in capsys.readouterr().out
    for way in ([], ["-k"]):
        assert cli.main(["merge", *way, "-m", "2000", "-o", f"{out}.merged", path]) == 0
        assert cli.main(["check", f"{out}.merged"]) == 0
        assert cli.main(["runs", "-m", "10000000", f"{out}.merged"]) == 0


def test_sweeps(monkeypatch, tmp_path, capsys):
    calls = []

    class Done:
        stdout = "x\n# elapsed time (keystrand): 1.000s\n"

    monkeypatch.setattr(cli.subprocess, "run", lambda args, **_: (calls.append(args[3:]), Done())[1])
    assert cli.main(["sweep", "--threads", "1,3", "-d", "2", str(tmp_path / "in")]) == 0
    assert [c[0] for c in calls] == ["sort"] * 4
    assert capsys.readouterr().out.count("# elapsed time") == 4
    calls.clear()
    assert cli.main(["sweep", "--weak", "-s", "100", "--threads", "2,4", "-d", "1", str(tmp_path / "in")]) == 0
    assert [(c[0], c[2]) for c in calls if c[0] == "gen"] == [("gen", "200"), ("gen", "400")] and "(nnodes=4, filesize=0, nthreads=4" in capsys.readouterr().out


def test_logs(here, tmp_path, capsys):
    (tmp_path / "x.log").write_text("(sequential kway merge, max_mem=1)\n# elapsed time (a): 4s\n(nthreads=2, max_mem=1)\n# elapsed time (b): 1s\n")
    assert cli.main(["logs", str(tmp_path / "x.log")]) == 0
    assert "4.0" in capsys.readouterr().out


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(threads=0)
    with pytest.raises(ValueError):
        Settings(max_payload=8)
