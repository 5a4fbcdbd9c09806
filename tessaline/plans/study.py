"""The whole analysis as named tables over one input; each is built once per session and kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.config import ALL23, ALLOWED_WINDOWS, FAMILIES, PELT_MULTIPLIERS, REDUCED_CANDIDATES
from tessaline.operators import boundaries as B
from tessaline.operators import calibration as C
from tessaline.operators import detectors as D
from tessaline.operators import inference as I
from tessaline.operators import matrix as M
from tessaline.operators import normalize as N
from tessaline.operators import quality as Q
from tessaline.operators import refit as R
from tessaline.operators.windows import window_features
from tessaline.sources.adapter import samples_from_events
from tessaline.sources.shared import settle

THRESHOLD = 20.0
LENGTHS = ALLOWED_WINDOWS
#: Configurations of a whole run: the most percent of corrected intervals, and the family of features that is scored.
CONFIGURATIONS = [(5.0, "heart_rate_rr"), (10.0, "heart_rate_rr"), (20.0, "heart_rate_rr"), (20.0, "hrv"), (20.0, "ecg_morphology"), (20.0, "all23")]


#: The window length that decides which features the pruned space has; the spaces that are fitted beyond the families; group keys of scores in several spaces.
PRIMARY = (20.0, "reduced")  # fixed value: the configuration that is reported first
REDUCED_FROM, FITTED, IN_SPACE = 30, ("reduced", "independent_pca"), [*C.GROUP, "Representation"]


class Study:
    """Tables of the analysis of one configuration, made on demand. Those that others use are written to the shared folder once, which keeps plans short.

    Configurations share what doesn't hang on them: the windows, and with an equal limit of corrected intervals all up to the normalisation.
    """

    LAZY = {"samples", "pseudo_obs", "real_scores", "pseudo_scores", "magnitude"}
    OF_INPUT = {"samples", "master", "sessions", "inventory"}
    OF_LIMIT = OF_INPUT | {
        "observations", "eligibility", "candidates", "matches", "pseudo_obs", "norm_real", "norm_pseudo", "crossfit", "fit_rows", "rank_rows", "session_lags", "space_lags",
        "spaces", "series_real", "series_pseudo", "space_real", "space_pseudo", "matrix_real_scores", "matrix_pseudo_scores", "magnitudes",
    }

    #: Tables that hold several spaces; below the widest limit only those of the configurations are scored.
    OF_SPACES = {"space_real", "space_pseudo", "matrix_real_scores", "matrix_pseudo_scores", "magnitudes"}

    def __init__(self, spark: SparkSession, events: DataFrame, subjects: int | None = None, corrected: float = THRESHOLD, space: str = "heart_rate_rr", base: Study | None = None):
        self.spark, self.events, self.subjects, self.made = spark, events, subjects, {}
        self.corrected, self.space, self.base, self.others = corrected, space, base, {}
        self.root = self if base is None else base.root

    def configured(self, corrected: float, space: str) -> Study:
        """The study of the same input in another configuration."""
        if (corrected, space) == (self.corrected, self.space):
            return self
        if self.base is not None:
            return self.root.configured(corrected, space)
        if (corrected, space) not in self.others:
            base = self if space == self.space else self.configured(corrected, self.space)
            self.others[corrected, space] = Study(self.spark, self.events, self.subjects, corrected, space, base)
        return self.others[corrected, space]

    def over(self, table: Callable[[Study], DataFrame], configurations: list[tuple[float, str]] = CONFIGURATIONS) -> DataFrame:
        """``table`` of every configuration, with the columns ``RRThreshold`` and ``Representation``."""
        parts = [table(self.configured(*c)).withColumns({"RRThreshold": F.lit(c[0]), "Representation": F.lit(c[1])}) for c in configurations]
        return reduce(DataFrame.unionByName, parts)

    def __getattr__(self, name: str) -> DataFrame:
        maker: Callable | None = type(self).__dict__.get(f"_{name}")
        if maker is None:
            raise AttributeError(name)
        if self.base is not None and name in (self.OF_LIMIT if self.base.corrected == self.corrected else self.OF_INPUT):
            if name not in self.OF_SPACES or self.base.scores(self.space):
                return getattr(self.base, name)
        if name not in self.made:
            made = maker(self)
            self.made[name] = made if name in self.LAZY else settle(made, f"study-{name}")
        return self.made[name]

    def _samples(self):
        return samples_from_events(self.events, self.subjects)

    def _master(self):
        return window_features(self.samples, LENGTHS)

    def _sessions(self):
        return Q.session_inventory(self.master)

    def _inventory(self):
        return B.boundary_inventory(self.sessions)

    def _observations(self):
        return B.boundary_observations(self.master, self.inventory, self.corrected)

    def _eligibility(self):
        return B.boundary_eligibility(self.observations, self.inventory, LENGTHS)

    def _candidates(self):
        return B.pseudo_candidates(self.master, self.corrected)

    def _matches(self):
        return B.match_controls(self.eligibility, self.inventory, self.candidates)

    def _pseudo_obs(self):
        return B.pseudo_observations(self.master, self.candidates, self.corrected)

    def _norm_real(self):
        return N.fit_normalisation(self.master, N.exclusion_keys_of_boundaries(self.inventory), ALL23, self.corrected)

    def _norm_pseudo(self):
        return N.fit_normalisation(self.master, N.exclusion_keys_of_sessions(self.sessions), ALL23, self.corrected)

    def features(self) -> list[str]:
        """Columns of the configuration's space."""
        return self.reduced()[0] if self.space == "reduced" else FAMILIES[self.space]

    def primary(self) -> Study:
        """The configuration that reports show first."""
        return self.configured(*PRIMARY)

    def _eligible_obs(self) -> DataFrame:
        return self.observations.join(self.eligibility.filter("Eligible").select("BoundaryID", "WindowLength_sec"), ["BoundaryID", "WindowLength_sec"], "left_semi")

    def _pseudo_key(self):
        return F.concat("Subject", F.lit("_S"), F.col("Session").cast("string"))

    def _long_real(self):
        ids = ["BoundaryID", "Subject", "TransitionType", "BoundaryOrder", "RelativeCenter_sec"]
        return N.apply_normalisation(self._eligible_obs(), self.norm_real, ids, self.features(), F.col("BoundaryID"))

    def _long_pseudo(self):
        return N.apply_normalisation(self.pseudo_obs, self.norm_pseudo, ["CandidateID", "RelativeCenter_sec"], self.features(), self._pseudo_key())

    # ---- linear spaces: fitted on cross-fitted stable windows, the scale that series have

    def _crossfit(self):
        return N.crossfit_stable(Q.stable_rows(self.master, self.corrected, 60.0), self.norm_pseudo, ALL23)

    def _fit_rows(self):
        """What covariances and components are fitted on: windows that don't overlap, as many of each subject and condition."""
        return M.balanced_rows(Q.thinned(self.crossfit), ALL23)

    def _rank_rows(self):
        """What the pruning is made on."""
        return M.balanced_rows(self.crossfit.filter(F.col("WindowLength_sec") == REDUCED_FROM), REDUCED_CANDIDATES, 50)

    def crossfit_long(self) -> DataFrame:
        ids = ["Subject", "Session", "WindowLength_sec", "WindowIndex"]
        return self.crossfit.unpivot(ids, ALL23, "Feature", "z")

    def _session_lags(self):
        return N.session_correlations(self.crossfit_long())

    def reduced(self) -> tuple[list[str], list[dict]]:
        """The pruned features and their audit: decided once, on the shortest windows of the widest limit, for all configurations."""
        first = self.root if self.root.corrected == THRESHOLD else self.root.configured(THRESHOLD, self.root.space)
        if "reduced" not in first.made:
            first.made["reduced"] = M.pruned(first.rank_rows, REDUCED_CANDIDATES, "WindowLength_sec").get(REDUCED_FROM, (REDUCED_CANDIDATES, []))
        return first.made["reduced"]

    def fits(self) -> dict[int, list[M.Representation]]:
        """Spaces by window length; fitted once for each limit of corrected intervals."""
        if self.base is not None and self.base.corrected == self.corrected:
            return self.base.fits()
        if "fits" not in self.made:
            kept = self.reduced()[0]
            found, _ = M.fit_representations(self.fit_rows, REDUCED_CANDIDATES, FAMILIES, {}, reduced=kept, whole=ALL23)
            loadings = self.spark.createDataFrame(M.loadings_of(found), "WindowLength_sec int, Feature string, Component int, centre double, weight double")
            of = self.spark.createDataFrame([(r.name, c) for r in next(iter(found.values()), []) if r.components is None for c in r.columns], "Representation string, Feature string")
            direct = N.pooled_correlation(self.session_lags.join(F.broadcast(of), "Feature"), ["WindowLength_sec", "Representation"])
            parts = N.session_correlations(M.components_scores(self.crossfit_long(), loadings))
            turned = N.pooled_correlation(parts.withColumn("Representation", F.lit("independent_pca")), ["WindowLength_sec", "Representation"])
            rho = {(r["WindowLength_sec"], r["Representation"]): r["lag1_rho"] for r in direct.unionByName(turned).collect()}  # lengths x spaces
            self.made["fits"] = M.with_rho(found, rho)
        return self.made["fits"]

    def _spaces(self):
        return M.space_table(self.spark, self.fits(), ALL23)

    def _series_real(self):
        return M.series_of(N.z_columns(self._eligible_obs(), self.norm_real, ALL23, F.col("BoundaryID")), ["BoundaryID", "WindowLength_sec"], ALL23)

    def _series_pseudo(self):
        return M.series_of(N.z_columns(self.pseudo_obs, self.norm_pseudo, ALL23, self._pseudo_key()), ["CandidateID", "WindowLength_sec"], ALL23)

    def scores(self, space: str) -> bool:
        """Whether this study's tables of several spaces hold ``space``."""
        return self.corrected == THRESHOLD or space == self.space or (self.corrected, space) in CONFIGURATIONS

    def scored_spaces(self) -> DataFrame:
        names = [r.name for r in next(iter(self.fits().values()), []) if self.scores(r.name)]
        return self.spaces.filter(F.col("Representation").isin(names))

    def _space_real(self):
        """Native scores of all real boundaries in all spaces, in one pass."""
        scores = D.score_spaces(self.series_real, ["BoundaryID", "WindowLength_sec"], self.scored_spaces())
        return scores.join(self.inventory.select("BoundaryID", "Subject", "TransitionType", "BoundaryOrder"), "BoundaryID")

    def _space_pseudo(self):
        return D.score_spaces(self.series_pseudo, ["CandidateID", "WindowLength_sec"], self.scored_spaces())

    def _magnitudes(self):
        return D.boundary_magnitude(self.series_real, ["BoundaryID", "WindowLength_sec"], self.scored_spaces())

    def _magnitude(self):
        return self.magnitudes.filter(F.col("Representation") == self.space).drop("Representation")

    def _real_scores(self):
        return self.space_real.filter(F.col("Representation") == self.space).drop("Representation")

    def _pseudo_scores(self):
        return self.space_pseudo.filter(F.col("Representation") == self.space).drop("Representation")

    def _expanded(self):
        return C.expand_scores(self.matches, self.pseudo_scores)

    def _thresholds(self):
        return C.crossfit_thresholds(self.expanded)

    def _results(self):
        return C.apply_thresholds(self.real_scores, self.expanded, self.thresholds)

    def _trends(self, series: DataFrame, key: str) -> DataFrame:
        fitted = {length: [r for r in found if r.name in FITTED] for length, found in self.fits().items()}
        return M.score_matrix(series, [key, "WindowLength_sec"], ALL23, fitted)

    def _matrix_real_scores(self):
        """All methods in the fitted spaces, and in the family spaces those that need no line."""
        trends = self._trends(self.series_real, "BoundaryID").join(self.inventory.select("BoundaryID", "Subject", "TransitionType", "BoundaryOrder"), "BoundaryID")
        return self.space_real.unionByName(trends)

    def _matrix_pseudo_scores(self):
        return self.space_pseudo.unionByName(self._trends(self.series_pseudo, "CandidateID"))

    def _matrix_expanded(self):
        return C.expand_scores(self.matches, self.matrix_pseudo_scores, IN_SPACE)

    def _matrix_thresholds(self):
        return C.crossfit_thresholds(self.matrix_expanded, group=IN_SPACE)

    def _matrix_results(self):
        return C.apply_thresholds(self.matrix_real_scores, self.matrix_expanded, self.matrix_thresholds, group=IN_SPACE)

    def _matrix_rates(self):
        return I.detection_rates(self.matrix_results, [*I.RATE_KEYS, "Representation"])

    # ---- leave-one-participant-out, with everything fitted anew

    def _fold_spaces(self):
        return R.fit_folds(self.crossfit, ALL23, REDUCED_CANDIDATES)

    def _fold_real(self):
        scores = R.score_folds(self.series_real, ["BoundaryID", "WindowLength_sec"], self.fold_spaces, PELT_MULTIPLIERS)
        return scores.join(self.inventory.select("BoundaryID", "Subject", "TransitionType"), "BoundaryID").filter("Subject = HeldOut")

    def _fold_pseudo(self):
        """Matches, up to 20 a boundary and condition, with the scores of their candidates in every fold."""
        scores = R.score_folds(self.series_pseudo, ["CandidateID", "WindowLength_sec"], self.fold_spaces, PELT_MULTIPLIERS)
        matches = self.matches.filter("MatchRank <= 20").select("CandidateID", "WindowLength_sec", "PseudoMatchID", "Subject", "TransitionType", "PseudoCondition", "CandidateBlockID", "MatchScore", "MatchRank")
        return matches.join(scores, ["CandidateID", "WindowLength_sec"])

    def _fold_thresholds(self):
        return R.training_thresholds(self.fold_pseudo.filter("Multiplier is null"))

    def _fold_penalties(self):
        return R.training_penalties(self.fold_pseudo.filter("Multiplier is not null"))

    def _fold_detections(self):
        return R.held_out_detections(self.fold_real, self.fold_pseudo, self.fold_thresholds, self.fold_penalties)

    def _pelt_real(self):
        scored = M.score_pelt(self.series_real, ["BoundaryID", "WindowLength_sec"], ALL23, self.fits(), PELT_MULTIPLIERS)
        return scored.join(self.inventory.select("BoundaryID", "Subject", "TransitionType"), "BoundaryID")

    def _pelt_expanded(self):
        return self.matches.join(M.score_pelt(self.series_pseudo, ["CandidateID", "WindowLength_sec"], ALL23, self.fits(), PELT_MULTIPLIERS), ["CandidateID", "WindowLength_sec"])

    def _pelt_multipliers(self):
        return C.crossfit_multipliers(self.pelt_expanded)

    def timing(self, endpoint: str = "departure"):
        """The timing stage of an endpoint, see ``plans.timing``."""
        from tessaline.plans.timing import Timing

        key = f"timing {endpoint}"
        if key not in self.made:
            self.made[key] = Timing(self, endpoint)
        return self.made[key]

    def _p_values(self):
        return C.empirical_p_values(self.real_scores, self.expanded)


_studies: dict[tuple[str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str, subjects: int | None = None) -> Study:
    """The study of a folder of tables; one per Spark application and folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}|{subjects}")
    if key not in _studies:
        for other in [k for k in _studies if k[0] != key[0]]:
            del _studies[other]
        _studies[key] = Study(spark, spark.read.parquet(f"{sf_dir}/events.parquet"), subjects)
    return _studies[key]
