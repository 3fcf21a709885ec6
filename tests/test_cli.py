"""The command line on a made run: dataset, track, report, seal, inspect, recommend, trackers, compare, sweep, warm-up, self-check."""

import pytest

from skein import cli


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cli") / "run")
    cli.main(["dataset", folder, "--particles", "40", "--frames", "6"])
    return folder


def test_track_report_seal(run, capsys):
    cli.main(["track", run, "--tracker", "two_phase"])
    cli.main(["report", run])
    cli.main(["seal", run])
    cli.main(["inspect", run])
    out = capsys.readouterr().out
    assert "links" in out and "correspondences" in out


def test_lists(spark, run, capsys, tmp_path):
    cli.main(["list-trackers"])
    cli.main(["recommend", run])
    cli.main(["inspect", str(tmp_path / "nothing")])
    out = capsys.readouterr().out
    assert "hybrid_deltat_3d" in out and "no store" in out


def test_experiments(spark, run, capsys):
    cli.main(["sweep", "--values", "0.5", "2.0", "--particles", "40", "--frames", "6"])
    cli.main(["warmup", run, "--frames", "4"])
    cli.main(["compare", "--trackers", "two_phase", "--particles", "40", "--frames", "6"])
    cli.main(["self-check"])
    out = capsys.readouterr().out
    assert "half 2.0" in out and "tried" in out and "two_phase" in out and "right" in out
