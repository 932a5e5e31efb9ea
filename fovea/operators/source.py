"""Where relations come from: one contract that summaries, contrasts and supplements take.

A source is a set of relation entries with the status of every relation and patient and the
endpoint masses that weigh them. Closed forms and fits both give one; what follows does not
know which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.operators import estimate, fitting, stats, summary
from fovea.schema import REL_PATIENT

SOURCE_NAMES = ["self_retention", "depletion", "off_diagonal_remodeling"]
TARGET_NAMES = ["matched_incoming_burden", "open_incoming_tendency", "open_incoming_burden"]


@dataclass(frozen=True)
class RelationSource:
    """entries: relation rows. status: relation, patient, fit_status (ok, deferred, failed), defer_reason.

    endpoints: relation, patient, x, y. Only relations with status ok are summarised; the
    others stay visible in the status and in every contrast.
    """

    entries: DataFrame
    status: DataFrame
    endpoints: DataFrame
    n_states: int

    @classmethod
    def closed_form(cls, entries: DataFrame, support: DataFrame, endpoints: DataFrame, n_states: int) -> "RelationSource":
        """A relation is ok when its entries exist."""
        return cls(entries, summary.fit_status(support, entries), endpoints, n_states)

    @classmethod
    def fitted(cls, entries: DataFrame, ledger: DataFrame, support: DataFrame, endpoints: DataFrame, n_states: int) -> "RelationSource":
        """A relation is ok when its fit is; patients left out or not finite are failed, with the reason."""
        told = ledger.select(*REL_PATIENT, F.col("status").alias("fit"))
        status = summary.fit_status(support, told.where(F.col("fit") == fitting.OK)).join(told, REL_PATIENT, "left")
        reason = F.when(F.col("fit_status") == "failed", F.coalesce("fit", F.lit("no_pairs"))).otherwise(F.col("defer_reason"))
        return cls(entries, status.withColumn("defer_reason", reason).drop("fit"), endpoints, n_states)

    def ok_entries(self) -> DataFrame:
        return self.entries.join(self.status.where("fit_status = 'ok'").select(*REL_PATIENT), REL_PATIENT, "left_semi")

    def packed(self) -> DataFrame:
        return summary.packed_with_burden(self.ok_entries(), self.endpoints, REL_PATIENT, self.n_states)

    def families(self) -> DataFrame:
        return summary.family_summaries(self.packed(), REL_PATIENT)

    def source_communities(self) -> DataFrame:
        return summary.source_communities(self.packed(), REL_PATIENT)

    def target_communities(self) -> DataFrame:
        return summary.target_communities(self.packed(), REL_PATIENT)

    def template(self) -> DataFrame:
        return estimate.cohort_template(self.ok_entries())

    def cohort(self) -> DataFrame:
        return estimate.cohort_summary(self.ok_entries(), self.n_states)

    def family_contrast(self, left: str, right: str) -> DataFrame:
        rows = [(name, scale) for name, *_ in summary.SUMMARIES for scale in summary.SCALES]
        return stats.paired_contrast(self.families(), self.status, ["summary_name", "scale"], rows, left, right)

    def _communities(self, table: DataFrame, key: str, names: list[str], left: str, right: str) -> DataFrame:
        rows = [(state, name) for state in range(self.n_states) for name in names]
        return stats.paired_contrast(stats.unpivot_communities(table, key, names), self.status, [key, "summary_name"], rows, left, right)

    def source_contrast(self, left: str, right: str) -> DataFrame:
        return self._communities(self.source_communities(), "source_community_id", SOURCE_NAMES, left, right)

    def target_contrast(self, left: str, right: str) -> DataFrame:
        return self._communities(self.target_communities(), "target_community_id", TARGET_NAMES, left, right)

    def cohort_contrast(self, left: str, right: str) -> DataFrame:
        return stats.cohort_contrast(self.template(), self.cohort(), left, right)

    def element_pairs(self, left: str, right: str) -> DataFrame:
        return stats.element_pairs(self.ok_entries(), left, right)

    def element_supplement(self, left: str, right: str) -> DataFrame:
        return stats.element_supplement(self.ok_entries(), left, right)
