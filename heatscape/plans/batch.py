"""The whole analysis over a set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatscape.functions.naming import UNASSIGNED, zone_label
from heatscape.operators import change, clusters, explain, gwr, models, spatial, trees, trend, validate
from heatscape.operators.clean import Cleaned, clean, has_structure
from heatscape.operators.collinearity import vif_screen
from heatscape.operators.gatekeeper import Gatekeeper, validate_coverage
from heatscape.operators.linear import LinearModel
from heatscape.operators.pooling import pool
from heatscape.operators.roles import RoleMap, infer_roles, is_trend_table, table_profile
from heatscape.session import materialise


@dataclass(frozen=True)
class Settings:
    mode: str = "full"
    trees: int | None = None
    rounds: int | None = None
    depth: int | None = None
    model_names: tuple | None = None
    audit_model: str = "LightGBM"
    gwr_points: int | None = None
    n_perm: int = gwr.PERMUTATIONS
    shap_rows: int | None = None
    keep_target_like: bool = False
    trend_value: str | None = None
    cluster_counts: tuple = tuple(clusters.K_RANGE)


def _add(results: dict, name: str, df: DataFrame | None) -> None:
    """Add rows to a result; they are written out, so that what fails does so in its stage and inputs can be released."""
    if df is None:
        return
    df, old = materialise(df), results.get(name)
    results[name] = df if old is None else old.unionByName(df, allowMissingColumns=True)


def _zone_of(df: DataFrame, name: str) -> str:
    return df.sparkSession.range(1).select(zone_label(F.lit(name)).alias("z")).first()["z"]


def keyed(df: DataFrame) -> DataFrame:
    """Give each row a number; written out so that it stays with the row."""
    return materialise(df.withColumn("row_id", F.monotonically_increasing_id()))


def attributions(d: DataFrame, model, tree_rows: int | None) -> tuple[DataFrame, float]:
    """Exact attributions of all rows, or of a sample of ``tree_rows`` if the model consists of trees and a number is given."""
    if isinstance(model, LinearModel):
        return explain.shap_columns(d, model)
    rows = d if tree_rows is None else explain.explain_sample(d, "row_id", tree_rows)
    return trees.tree_shap(rows, model if isinstance(model, trees.Trees) else model.as_trees())


class Stages:
    """Runs the stages of an analysis one by one; a failing one leaves a row and the others go on."""

    def __init__(self):
        self.rows: list[tuple] = []

    def attempt(self, zone: str, stage: str, call, *needs):
        """What ``call`` returns, or None if it fails or one of ``needs`` is missing."""
        if any(x is None for x in needs):
            self.rows.append((zone, stage, "skipped", "an earlier stage gave nothing"))
            return None
        try:
            out = call()
        except Exception as error:  # whatever a stage may raise
            self.note(zone, stage, error)
            return None
        self.rows.append((zone, stage, "ok", None))
        return out

    def note(self, zone: str, stage: str, error: Exception) -> None:
        text = str(error).strip().splitlines()
        self.rows.append((zone, stage, "failed", f"{type(error).__name__}: {text[0] if text else ''}"[:300]))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "Zone string, stage string, status string, message string")


def analyse_zone(frame: DataFrame, roles: RoleMap, zone: str, results: dict, s: Settings = Settings(), stages: Stages | None = None,
                 zoo: dict | None = None) -> None:
    """Screening, validation, local regression, attribution, gate and clusters of one zone."""
    stages = stages or Stages()
    y, xy = roles.lst, (roles.lon, roles.lat)
    tag = F.lit(zone)
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    def screen():
        feats, history = vif_screen(frame, roles.features(s.keep_target_like))
        _add(results, "vif_screening", history.withColumn("Zone", tag))
        return feats

    def design():
        d = frame.select("row_id", *[F.col(f"`{c}`") for c in xy if c], F.col(f"`{y}`"), *[F.col(f"`{c}`") for c in feats])
        d, how = spatial.spatial_blocks(d, roles.lon, roles.lat, feats, "row_id")
        return keep(spatial.random_folds(spatial.assign_folds(d, "row_id"), "row_id", out="random_fold")), how

    def benchmark():
        failed: dict = {}
        bench, oof = validate.benchmark(d, "row_id", feats, y, zoo, zone, failed=failed)
        for name, error in failed.items():
            stages.note(zone, f"model {name}", error)
        oof = keep(oof)
        _add(results, "model_benchmark", bench)
        return oof, bench.orderBy(F.desc("R2")).first()["Model"]

    def audit():
        name = s.audit_model if s.audit_model in zoo else list(zoo)[-1]
        found = validate.leakage_audit(d, "row_id", feats, y, name, zoo[name], oof=oof)
        found = found.withColumns({"zone": tag, "design": F.lit(how)})
        if all(xy):
            resid = oof.where(F.col("model") == best).select("row_id", (F.col("y") - F.col("prediction")).alias("resid"))
            of_target = spatial.morans_i(d, y, *xy, "row_id").first()["morans_i"]
            of_resid = spatial.morans_i(d.join(resid, "row_id"), "resid", *xy, "row_id").first()["morans_i"]
            found = found.withColumns({"morans_I_target": F.lit(of_target).cast("double"),
                                       "morans_I_residual": F.lit(of_resid).cast("double")})
            found = found.withColumn("verdict", spatial.residual_verdict(F.col("morans_I_residual")))
        _add(results, "spatial_leakage_audit", found)

    def local():
        fits = gwr.gwr(d, "row_id", *xy, feats, y, s.gwr_points, s.n_perm)
        _add(results, "gwr_nonstationarity", fits["summary"].withColumn("Zone", tag))
        _add(results, "gwr_runs", fits["meta"].withColumn("Zone", tag))
        fits["local"].unpersist()

    def refit():
        parts = keep(validate.refit_split(d, "row_id"))
        rows = {p: parts.where(F.col("part") == p) for p in ("fit", "calibrate", "test")}
        return rows, zoo[best](rows["fit"], feats, y)

    def explained():
        shap, base = attributions(d, model, s.shap_rows)
        shap = keep(shap)
        imp = explain.importance(explain.shap_long(shap, "row_id", feats))
        _add(results, "shap_feature_importance", imp.select(tag.alias("Zone"), "*").orderBy(F.desc("MeanAbsSHAP")))
        _add(results, "local_hotspot_explanations", explain.local_explanations(shap, "row_id", y, feats, base).withColumn("Zone", tag))
        _add(results, "shap_interactions", explain.interactions(shap, feats).withColumn("Zone", tag))

    def gate():
        fitted = Gatekeeper("row_id", tuple(feats)).fit(model, rows["calibrate"], rows["fit"], y)
        held.append(fitted.half_b)
        scored = keep(fitted.score(rows["test"]).withColumn("zone", tag))
        _add(results, "gatekeeper_validation", validate_coverage(scored, y, fitted, ["zone"]).withColumn("model", F.lit(best)))
        _add(results, "gatekeeper_scores", scored.select(
            "zone", "row_id", F.col(f"`{y}`").alias("y"), "prediction", "lower", "upper", "interval_width", "applicability_score",
            "conformal_score", "trust_score", "verdict"))

    def climate():
        table, _, meta = clusters.discover(d, feats, y, s.cluster_counts, key="row_id")
        _add(results, "local_climate_zones", table.withColumns({"Zone": tag, "chosen_k": F.lit(meta["chosen_k"]), "silhouette": F.lit(meta["silhouette"])}))
        _add(results, "cluster_counts", frame.sparkSession.createDataFrame(
            [(zone, int(k), float(v)) for k, v in meta["all_scores"].items()], "Zone string, k int, silhouette double"))

    feats = stages.attempt(zone, "vif_screening", screen)
    d, how = stages.attempt(zone, "design", design, feats) or (None, None)
    zoo = zoo or models.model_zoo("row_id", s.mode, s.trees, s.rounds, s.depth)
    zoo = {n: m for n, m in zoo.items() if s.model_names is None or n in s.model_names}
    oof, best = stages.attempt(zone, "model_benchmark", benchmark, d) or (None, None)
    stages.attempt(zone, "spatial_leakage_audit", audit, oof)
    if all(xy):
        stages.attempt(zone, "gwr", local, d)
    rows, model = stages.attempt(zone, "refit", refit, best) or (None, None)
    stages.attempt(zone, "shap", explained, model)
    stages.attempt(zone, "gatekeeper", gate, model)
    stages.attempt(zone, "climate_zones", climate, d)
    for df in held:
        df.unpersist()


def run(tables: dict[str, DataFrame], settings: Settings = Settings(), zoo: dict | None = None) -> dict[str, DataFrame]:
    """Result tables of all inputs; see :mod:`heatscape.sources.sinks` for their names.

    ``stage_status`` has a row for each stage of each zone, and for each model that could not be fitted; what fails
    leaves the other stages, models and tables as they are.  ``zoo`` replaces the models by fitters of one's own.
    """
    results: dict[str, DataFrame] = {"table_profile": table_profile(tables)}
    stages = Stages()
    cleaned: list[tuple[str, Cleaned]] = []
    for name, df in tables.items():
        zone = _zone_of(df, name)
        if is_trend_table(name, df):
            long = stages.attempt(zone, f"trend {name}", lambda df=df: trend.tidy(df, settings.trend_value))
            if long is not None:
                stages.attempt(zone, f"temporal_trends {name}", lambda long=long, zone=zone: _add(results, "temporal_trends", trend.trend_table(long, zone)))
            continue
        roles = infer_roles(df, name)
        if roles.lst is None or len(roles.features()) < 2:
            continue
        c = clean(keyed(df), roles, keep=("row_id",))
        _add(results, "cleaning", c.report)
        frame = c.frame.persist()
        c = Cleaned(frame, c.roles, c.report)
        if has_structure(c, frame.count()):
            analyse_zone(frame, c.roles, zone, results, settings, stages, zoo)
        cleaned.append((zone, c))
    if len(cleaned) >= 2:
        pooled, roles = pool(cleaned)
        if len(roles.indices) >= 1:
            analyse_zone(keyed(pooled), roles, "Pooled (N+S)", results, settings, stages, zoo)
    # the first table of each zone; a zone isn't compared with itself
    named: dict[str, Cleaned] = {}
    for z, c in cleaned:
        if z != UNASSIGNED:
            named.setdefault(z, c)
    if len(named) >= 2:
        (za, a), (zb, b) = list(named.items())[:2]
        common = sorted(set(a.roles.indices) & set(b.roles.indices))

        def renamed(c):
            return c.frame.select("row_id", F.col(f"`{c.roles.lst}`").alias("LST"),
                                  *[F.col(f"`{c.roles.indices[k]}`").alias(k) for k in common])
        def changed():
            aligned = change.rank_aligned(renamed(a), renamed(b), "LST", common, "row_id").persist()
            _add(results, "change_detection_drivers", change.change_drivers(
                aligned, common, f"{zb} minus {za}", models.boosted("LightGBM", settings.rounds or 400)))
            aligned.unpersist()

        stages.attempt(f"{zb} minus {za}", "change_detection", changed)
    for _, c in cleaned:
        c.frame.unpersist()
    if stages.rows:
        results["stage_status"] = stages.table(next(iter(tables.values())).sparkSession)
    return results
