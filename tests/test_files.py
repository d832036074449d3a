import json

import pytest

from warpspark import cli, errors
from warpspark.sources.readers import read_attributes, read_series
from warpspark.sources.writers import ResultWriter

SERIES = {"B01": (0.1, 0.2, 0.0), "B02": (0.0, 0.1, 0.2), "B03": (5, 5.1, 5.2), "B04": (5.2, 5, 5.1), "B05": (10, 10.1, 10.2), "B06": (10.2, 10, 10.1)}


@pytest.fixture
def data(tmp_path):
    lines = ["basin_id," + ",".join(f"t{i}" for i in range(12))] + [f"{k}," + ",".join(map(str, v * 4)) for k, v in SERIES.items()]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    rows = [f"{k},{i // 2 * 10 + i},{i % 2}" for i, k in enumerate(SERIES)] + ["B99,1,2"]
    (tmp_path / "a.csv").write_text("\n".join(["basin_id,area,slope", *rows]) + "\n")
    return tmp_path


def test_reads_series_and_attributes(spark, data):
    t = read_series(spark, str(data / "s.csv"))
    rows = t.rows.orderBy("row").collect()
    assert [r["id"] for r in rows] == list(SERIES) and rows[2]["series"][:3] == [5.0, 5.1, 5.2]
    assert read_attributes(spark, str(data / "a.csv")).names == ["area", "slope"]


@pytest.mark.parametrize(
    "text,error",
    [
        ("basin_id,t0,t1,t2\n", errors.EmptyDataset),
        ("basin_id,t0,t1\nB01,1,2\nB02,1,2\nB03,1\n", errors.InconsistentRowLength),
        ("basin_id,t0,t1\nB01,1,2,3\n", errors.InconsistentRowLength),
        ("basin_id,t0,t1\nB01,1,2\nB02,1,NaN\n", errors.NonFiniteCell),
        ("basin_id,t0,t1\nB01,1,Inf\n", errors.NonFiniteCell),
        ("basin_id,t0,t1\nB01,1,1.0d\n", errors.NonFiniteCell),
        ("basin_id,t0,t1\nB01,1, 2\n", errors.NonFiniteCell),
        ("basin_id,t0\nB01,1\nB02,2\nB01,3\n", errors.DuplicateId),
        ('basin_id,t0,t1\n"B01,1.0,2.0\n', errors.InconsistentRowLength),
        ("basin_id,t0\n,1\n", errors.EmptyId),
        ("basin_id\nB01\n", errors.EmptyDataset),
    ],
)
def test_bad_files(spark, tmp_path, text, error):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(error):
        read_series(spark, str(tmp_path / "x.csv"))


def test_other_errors(spark, tmp_path):
    with pytest.raises(errors.SourceNotFound):
        read_series(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.csv").write_text("basin_id\nB01\n")
    with pytest.raises(errors.NoFeatureColumns):
        read_attributes(spark, str(tmp_path / "x.csv"))
    with pytest.raises(errors.InvalidExperimentName):
        ResultWriter(str(tmp_path), "no spaces")


def test_commands_end_to_end(spark, data):
    common = ["--experiment", "e1", "--output-dir", str(data / "out")]
    tuning = [*common, "--data", str(data / "s.csv"), "--n-init", "3"]
    cli.run(spark, ["cluster", *tuning, "--k", "3"])
    found = json.loads((data / "out/e1_cluster.json").read_text())
    c = found["assignments"]
    assert list(c) == sorted(SERIES) and c["B01"] == c["B02"] != c["B03"] == c["B04"] != c["B05"] == c["B06"] and found["cluster_sizes"] == [2, 2, 2]
    got = cli.run(spark, ["optimize", *tuning, "--min-k", "2", "--max-k", "5", "--silhouette"])
    assert got["best_k"] == 3 and json.loads((data / "out/e1_optimize.json").read_text())["n_basins"] == 6
    cli.run(spark, ["evaluate", *tuning, "--k", "3", "--attributes", str(data / "a.csv"), "--cv-folds", "2", "--n-trees", "8"])
    e = json.loads((data / "out/e1_evaluate.json").read_text())
    assert e["n_classes"] == 3 and len(e["fold_accuracies"]) == 2 and {f["name"] for f in e["feature_importances"]} == {"area", "slope"}
    cli.run(spark, ["predict", *common, "--model", str(data / "out/e1_model"), "--attributes", str(data / "a.csv"), "--top-k", "2"])
    p = json.loads((data / "out/e1_predict.json").read_text())
    assert p["n_basins"] == 7 and all(len(x["top_k"]) == 2 and x["predicted_class"] == x["top_k"][0]["class"] for x in p["predictions"])
