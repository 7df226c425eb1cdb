"""Model keys with small parameters: invariants, stored forest, metrics record."""
import pytest

from vendorlens import constants as K
from vendorlens.plans import scoring as SC
from vendorlens.registry import REGISTRY
from vendorlens.suite import models

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    full = models.KEY_PARAMS
    assert (full.num_trees, full.max_depth, full.min_leaf, full.lr_max_iter) == (400, 30, 5, 3000)
    models.KEY_PARAMS = SC.ModelParams(num_trees=3, max_depth=3, lr_max_iter=5)
    yield
    models.KEY_PARAMS = full


def test_scores_metrics_and_what_if(spark, small):
    oos = REGISTRY["oos_scores"].build(spark, SF).collect()
    assert oos and len({(r.supplier_id, r.fiscal_quarter) for r in oos}) == len(oos)
    assert all(0 <= p <= 1 for r in oos for p in (r.prob_rf, r.prob_lr))
    m = REGISTRY["model_metrics"].build(spark, SF).first()
    assert m.n_oos == len(oos) and 0 <= m.base_rate <= 1 and len(m.quarters_scored.split(",")) == len({r.fiscal_quarter for r in oos})
    aucs = {r.model: r.auc for r in REGISTRY["auc_models"].build(spark, SF).collect()}
    assert aucs == {"rf": m.auc_rf, "lr": m.auc_lr, "benchmark": m.auc_benchmark}
    assert REGISTRY["feature_importance"].build(spark, SF).count() > 0
    swings = REGISTRY["lever_sensitivity"].build(spark, SF).collect()
    assert swings and all(abs(r.swing - (r.worst - r.best)) < 1e-5 for r in swings)
    assert all(abs(r.delta - (r.new_prob - r.base_prob)) < 1e-5 for r in REGISTRY["scenario_rescore"].build(spark, SF).collect())


def test_saved_model_scores_alike(spark, small, tmp_path):
    panel = models._panel(spark, SF)
    prep, model = SC.final_model(panel, models.KEY_PARAMS)
    SC.save_model(prep, model, str(tmp_path))
    prep2, model2 = SC.load_model(spark, str(tmp_path))
    assert prep2 == prep
    def probs(p, m):
        return {(r.supplier_id, r.qi): r.prob for r in SC._prob(m, p.transform(panel)).select("supplier_id", "qi", "prob").collect()}
    assert probs(prep, model) == probs(prep2, model2)
    again = SC.final_model(panel, models.KEY_PARAMS)[1]
    assert probs(prep, again) == probs(prep, model)


def test_unknown_level_and_missing_value(spark):
    rows = [(1.0, "a"), (3.0, "b"), (None, "b")]
    prep = SC.fit_prep(spark.createDataFrame(rows, "x double, c string"), ["x"], ["c"])
    assert prep.medians == {"x": 2.0} and prep.levels == {"c": ["a", "b"]}
    out = prep.transform(spark.createDataFrame([(None, "z")], "x double, c string")).first()
    assert out.features.toArray().tolist() == [0.0, 0.0]


def test_fold_statistics_equal_a_fit_per_fold(spark):
    panel = models._panel(spark, SF)
    num, cat = models.PANEL_NUMERIC, K.CATEGORICAL_FEATURES
    folds = [6, 9, 15, 40]
    got = SC.fold_statistics(panel, num, cat, folds)
    for t in folds:
        train = panel.where(f"qi < {t}")
        want = SC.fit_prep(train, num, cat)
        assert got[t].prep.medians == want.medians and got[t].prep.levels == want.levels
        assert got[t].prep.means == pytest.approx(want.means, rel=1e-12, abs=1e-12)
        assert got[t].prep.stds == pytest.approx(want.stds, rel=1e-9, abs=1e-12)
        assert (got[t].rows, got[t].positives) == (train.count(), train.where(f"{K.TARGET} = 1").count())
    gone = panel.withColumn("lines", SC.F.lit(None).cast("long"))
    empty = SC.fold_statistics(gone, ["lines", "po_count"], cat, [9])[9].prep
    assert empty.medians["lines"] is None and empty.means["lines"] == empty.stds["lines"] == 0.0


def test_folds_resume(spark, tmp_path):
    panel = models._panel(spark, SF)
    params = SC.ModelParams(num_trees=3, max_depth=3, lr_max_iter=5)
    path = str(tmp_path / "folds")
    SC.store_folds(panel.where("qi <= 9"), params, path)
    first = {r.supplier_id: r.prob_rf for r in SC.read_folds(spark, path).where("fiscal_quarter is not null").collect()}
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert first and sorted(p.name for p in (tmp_path / "folds").iterdir()) == ["qi=6", "qi=7", "qi=8", "qi=9"]
    (tmp_path / "folds" / "qi=8" / "_SUCCESS").unlink()  # the run was killed while it wrote this fold
    SC.store_folds(panel.where("qi <= 11"), params, path)
    again = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert {p for p in files if "qi=8" not in str(p)} == {p for p in files if again.get(p) == files[p]}
    whole = str(tmp_path / "whole")
    SC.store_folds(panel.where("qi <= 11"), params, whole)
    key = lambda r: (r.supplier_id, r.fiscal_quarter)
    assert sorted(SC.read_folds(spark, path).collect(), key=key) == sorted(SC.read_folds(spark, whole).collect(), key=key)
    nothing = str(tmp_path / "none")
    SC.store_folds(panel.where("qi < 3"), params, nothing)
    assert SC.read_folds(spark, nothing).count() == 0


def test_regression_scores_need_no_forest(spark, small, tmp_path, monkeypatch):
    panel = models._panel(spark, SF).where("qi <= 8")
    both, alone = str(tmp_path / "both"), str(tmp_path / "alone")
    SC.store_folds(panel, models.KEY_PARAMS, both)
    monkeypatch.setattr(SC.RandomForestClassifier, "fit", lambda *_: pytest.fail("a forest is fitted"))
    models.stored.forget(SF)
    assert REGISTRY["lr_scores"].build(spark, SF).where("prob_lr is null").count() == 0
    SC.store_folds(panel, models.KEY_PARAMS, alone, kinds=("lr",))
    read = lambda df: {(r.supplier_id, r.fiscal_quarter): r.prob_lr for r in df.collect()}
    want, got = read(SC.read_folds(spark, both)), read(SC.read_folds(spark, alone, kinds=("lr",)))
    assert want and got == pytest.approx(want, abs=1e-9)


def test_auc_and_triage_over_the_stored_scores_match_sql(spark, small, tmp_path):
    import duckdb

    rows = models._oos_panel(spark, SF)
    rows.coalesce(1).write.parquet(str(tmp_path / "scores"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW s AS SELECT * FROM read_parquet('{tmp_path}/scores/*.parquet')")
    y = K.TARGET
    aucs = {r.model: r.auc for r in REGISTRY["auc_models"].build(spark, SF).collect()}
    triage = {r.model: r for r in REGISTRY["capacity_triage_models"].build(spark, SF).collect()}
    for name, label, col in (("rf", "Random Forest", "prob_rf"), ("lr", "Logistic Regression", "prob_lr"), ("benchmark", "Single column rule", "prob_benchmark")):
        want = con.execute(f"""
            SELECT sum(CASE WHEN a.{col} > b.{col} THEN 1.0 WHEN a.{col} = b.{col} THEN 0.5 ELSE 0 END) / count(*)
            FROM s a JOIN s b ON a.{y} = 1 AND b.{y} = 0 WHERE a.{col} IS NOT NULL AND b.{col} IS NOT NULL""").fetchone()[0]
        assert aucs[name] == pytest.approx(want, abs=1e-6)
        reviewed, caught = con.execute(f"""
            SELECT count(*), sum({y}) FROM (SELECT {y}, row_number() OVER (PARTITION BY fiscal_quarter ORDER BY {col} DESC, supplier_id) AS r FROM s) t
            WHERE r <= {K.DEFAULT_CAPACITY}""").fetchone()
        assert (triage[label].reviewed, triage[label].caught) == (reviewed, caught)
    m = REGISTRY["model_metrics"].build(spark, SF).first()
    n, base, quarters = con.execute(f"SELECT count(*), avg({y}), string_agg(DISTINCT fiscal_quarter, ',') FROM s").fetchone()
    assert (m.n_oos, set(m.quarters_scored.split(","))) == (n, set(quarters.split(","))) and m.base_rate == pytest.approx(base, abs=1e-6)
    assert (m.auc_rf, m.auc_lr, m.auc_benchmark) == (aucs["rf"], aucs["lr"], aucs["benchmark"])


def _labelled(spark, n=120):
    rows = [(i, "FY1", 1 + i % 4, float(i % 17), float(i * 7 % 23), "ab"[i % 2], int(i % 17 > 8) if i % 5 else i % 2) for i in range(n)]
    return spark.createDataFrame(rows, f"supplier_id long, fiscal_quarter string, qi int, x double, z double, c string, {K.TARGET} int")


def test_a_forest_in_parts_has_all_trees_and_their_mean_vote(spark, tmp_path):
    full = SC.ModelParams()
    assert [p.num_trees for p in full.parts(26_000)] == [50] * 8 and len({p.seed for p in full.parts(26_000)}) == 8
    assert full.parts(2_600) == [full]  # a forest over few rows is fitted as before
    assert [p.num_trees for p in SC.ModelParams(num_trees=5, row_trees_per_part=1).parts(100)] == [1] * 5
    folds = lambda *rows: {t: SC.Fold(None, n, 1) for t, n in enumerate(rows)}
    assert [SC.folds_at_once(x, full) for x in (folds(), folds(2_600), folds(600, 26_000))] == [12, 12, 3]
    params = SC.ModelParams(num_trees=7, max_depth=4, most_parts=3, row_trees_per_part=1)
    rows = _labelled(spark)
    prep = SC.fit_prep(rows, ["x", "z"], ["c"])
    fold = SC.Fold(prep, 120, rows.where(f"{K.TARGET} = 1").count())
    train = SC.training_rows(rows, fold, params)
    forest = SC.fit_forest(train, fold.rows, params)
    trees = [t for m in forest.parts for t in m.trees]
    assert [m.getNumTrees for m in forest.parts] == [3, 2, 2] and forest.num_trees == len(trees) == 7
    got = {r.supplier_id: r.prob for r in forest.score(train).collect()}
    want = dict.fromkeys(got, 0.0)
    for t in trees:
        for r in t.transform(train).select("supplier_id", "probability").collect():
            want[r.supplier_id] += r.probability[1] / 7
    assert len(got) == 120 and got == pytest.approx(want, abs=1e-12)
    means = sum(t.featureImportances.toArray() for t in trees if t.numNodes > 1) / sum(t.numNodes > 1 for t in trees)
    assert forest.importances == pytest.approx(means.tolist(), abs=1e-12)
    SC.save_model(prep, forest, str(tmp_path / "m"))
    prep2, forest2 = SC.load_model(spark, str(tmp_path / "m"))
    again = SC.fit_forest(train, fold.rows, params)
    for other in (forest2, again):
        assert {r.supplier_id: r.prob for r in other.score(train).collect()} == got
    assert prep2 == prep


def test_a_sweep_and_a_scenario_score_their_rows_once(spark, monkeypatch):
    rows = _labelled(spark).withColumn("supplier_id", SC.F.expr("nullif(supplier_id, 3)"))
    prep = SC.fit_prep(rows, ["x", "z"], ["c"])
    params = SC.ModelParams(num_trees=3, max_depth=3)
    fold = SC.Fold(prep, 120, rows.where(f"{K.TARGET} = 1").count())
    forest = SC.fit_forest(SC.training_rows(rows, fold, params), 120, params)
    levers = [("x", "X", 0.0, 16.0, 1.0), ("z", "Z", 0.0, 22.0, 1.0)]
    out = SC.lever_sensitivity(rows.coalesce(1), prep, forest, levers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1
    got = out.collect()
    assert len(got) == 240
    by = {}
    for r in got:
        by.setdefault(r.supplier_id, []).append((r.swing, r.lever, r.strongest_lever))
    assert all({s for _, _, s in v} == {max(v)[1] if k is not None else None} for k, v in by.items())
    assert SC.lever_tasks(spark.range(10)) == 1 and SC.lever_tasks(spark.range(1 << 20)) == 1024
    asked = []
    score = SC.Forest.score
    monkeypatch.setattr(SC.Forest, "score", lambda self, df: asked.append(1) or score(self, df))
    sim = SC.scenario_rescore(rows, prep, forest, {"x": 2.0}, levers).collect()
    assert len(asked) == 1 and len(sim) == 119
    base = {r.supplier_id: r.prob for r in score(forest, prep.transform(rows)).collect()}
    new = {r.supplier_id: r.prob for r in score(forest, prep.transform(SC.adjusted_rows(rows, prep, {"x": 2.0}, levers))).collect()}
    assert all(r.base_prob == pytest.approx(base[r.supplier_id]) and r.new_prob == pytest.approx(new[r.supplier_id]) for r in sim)
