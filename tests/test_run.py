from firmlens import PanelStudy
from firmlens.config import STAND_IN


def test_full_run_writes_the_summary(spark, stand_in, tmp_path):
    out = str(tmp_path / "model_summary_results")
    reports = PanelStudy(stand_in, STAND_IN).run(out)
    assert set(reports) == set(PanelStudy.REPORTS)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["Variable", "Obs", "Firms", "R2", "Adj_R2", "F_stat"]
    assert [r.Variable for r in back.collect()] == [r.depvar for r in reports["fe_summary"].collect()]
    lazy = PanelStudy(stand_in, STAND_IN)
    for name in ("size_distribution", "panel_balance", "assets_wide", "size_stats"):
        assert reports[name].collect() == getattr(lazy, name)().collect()
