"""Population timing as one stage: real fits, nulls, bands, bootstraps, left-out fits, paired differences and power, all from the same trajectories and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators import detectors as D
from tessaline.operators import timing as T
from tessaline.plans.study import FITTED, Study
from tessaline.sources.shared import settle

KEYS = ["TransitionType", "WindowLength_sec", "Representation"]
ENDPOINTS = {"departure": T.departure, "signed": T.signed}


class Timing:
    """Named tables of one endpoint in the fitted spaces; those that others use are written once.

    ``departure``: distance from the state before the boundary, in whitened coordinates. ``signed``: the coordinates themselves, which share one change.
    ``draws``: pseudo draws of each condition; ``replicates``: bootstrap draws; ``power_draws``: those of the pseudo draws that changes are added to.
    """

    def __init__(self, study: Study, endpoint: str = "departure", draws: int = 100, replicates: int = 200, power_draws: int = 20, least_participants: int = 10):
        self.study, self.endpoint, self.draws, self.replicates, self.power_draws, self.least, self.made = study, ENDPOINTS[endpoint], draws, replicates, power_draws, least_participants, {}

    def __getattr__(self, name: str) -> DataFrame:
        maker = type(self).__dict__.get(f"_{name}")
        if maker is None:
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = settle(maker(self), f"timing-{name}")
        return self.made[name]

    def white(self, series: DataFrame, key: str) -> DataFrame:
        spaces = self.study.spaces.filter(F.col("Representation").isin(*FITTED))
        return D.project(series, [key, "WindowLength_sec"], spaces, "white")

    def _values(self):
        """The endpoint of every real boundary."""
        known = self.study.inventory.select("BoundaryID", "Subject", "TransitionType")
        return self.endpoint(self.white(self.study.series_real, "BoundaryID").join(known, "BoundaryID"), ["BoundaryID", *KEYS])

    def _pseudo_values(self):
        known = self.study.candidates.select("CandidateID", "Subject").distinct()
        return self.endpoint(self.white(self.study.series_pseudo, "CandidateID").join(known, "CandidateID"), ["CandidateID", "WindowLength_sec", "Representation"])

    def _trajectory(self):
        return T.participant_trajectory(self.values, KEYS)

    def _choices(self):
        """The draws that all nulls share."""
        return T.pseudo_choices(self.study.matches, ["TransitionType", "WindowLength_sec", "PseudoCondition"], self.draws)

    def _null(self):
        """Null trajectories of both conditions."""
        return T.pseudo_draws(self.pseudo_values, self.choices, ["TransitionType", "WindowLength_sec", "PseudoCondition"], ["Representation"])

    def _scarcity(self):
        return T.scarcity(self.choices, ["TransitionType", "WindowLength_sec", "PseudoCondition"])

    def _fits(self):
        return T.group_fits(self.trajectory, KEYS, self.least)

    def _profiles(self):
        return T.group_profiles(self.trajectory, KEYS, self.least)

    def _null_fits(self):
        return T.group_fits(self.null, [*KEYS, "PseudoCondition", "rep"], self.least)

    def _bands(self):
        """Null scores at each candidate time, for both conditions."""
        return T.null_bands(T.group_profiles(self.null, [*KEYS, "PseudoCondition", "rep"], self.least), [*KEYS, "PseudoCondition", "SearchWindow"])

    def _summary(self):
        """Real fits with their p values and thresholds against both nulls."""
        of = lambda c: self.null_fits.filter(F.col("PseudoCondition") == c)
        return T.dual_status(self.fits, of("A"), of("NA"), [*KEYS, "SearchWindow"])

    def _bootstrap(self):
        return T.resampled_fits(self.trajectory, KEYS, self.replicates, least_participants=self.least)

    def _left_out(self):
        return T.resampled_fits(self.trajectory, KEYS, how="leave_one_out", least_participants=self.least - 1)

    def _paired(self):
        """Differences of the two directions' times over the participants that have both."""
        keys = ["WindowLength_sec", "Representation"]
        fits = T.resampled_fits(T.common_participants(self.trajectory, keys), KEYS, self.replicates, least_participants=self.least)
        return T.paired_differences(fits, keys)

    def _power(self):
        some = self.null.filter(F.col("rep") < self.power_draws)
        return T.timing_power(some, self.summary, self.profiles, KEYS, ["PseudoCondition"])
