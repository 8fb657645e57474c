"""Batch plans: the live pipeline's stages as one Spark job chain.

tracking -> enriched (rates, edge, distance, zone, automaton flags)
         -> extracted -> merged -> filtered -> classified -> scored

Stages that later steps read more than once (or read with different column
sets) are cut (``session.cut``): written once as a Parquet table in the shared
checkpoint folder -- the batch twin of the reference's topics -- so they are
computed once, survive lost executors and take pushed-down filters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pitchload.operators import events as E
from pitchload.operators import kinematics as K
from pitchload.operators import scoring as SC
from pitchload.operators.sequence import SEGMENT_ROWS
from pitchload.session import cut
from pitchload.sources import tables

@dataclass
class Chain:
    """Lazily built, memoised stages of one plan over one input directory, or over
    ``source`` (e.g. ``sources.files.read_tracking_records``) when given."""
    spark: SparkSession
    sf_dir: str
    keys: list[str] = field(default_factory=lambda: list(tables.TRACKING_KEYS))
    seg_rows: int = SEGMENT_ROWS
    materialize: bool = True
    cut_inner: bool = True
    source: DataFrame | None = None     # rows with keys, ts_ms, team, jersey_number, x, y (cm), speed
    _memo: dict = field(default_factory=dict)

    def _m(self, df: DataFrame) -> DataFrame:
        return cut(df) if self.materialize else df

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    def raw(self) -> DataFrame:
        if self.source is not None:
            return self._get("raw", lambda: self.source)
        return self._get("raw", lambda: tables.tracking(self.spark, self.sf_dir))

    def tracking(self) -> DataFrame:
        return self._get("tracking", lambda: K.lag_rate(self.raw(), self.keys, seg_rows=self.seg_rows))

    def rows(self) -> DataFrame:
        """Enriched rows without automaton flags, not cut: for queries that read them once,
        so Catalyst prunes every column (and window) they do not use."""
        return self._get("rows", lambda: K.enrich(self.raw(), self.keys, seg_rows=self.seg_rows, flags=False))

    def enriched(self) -> DataFrame:
        return self._get("enriched", lambda: self._m(K.enrich(self.raw(), self.keys, seg_rows=self.seg_rows)))

    def extracted(self) -> DataFrame:
        return self._get("extracted", lambda: self._m(E.extract_events(
            self.enriched(), self.keys, seg_rows=self.seg_rows,
            materialize=self._m if self.materialize and self.cut_inner else None)))

    def merged(self, flush_open: bool = False) -> DataFrame:
        return self._get(f"merged{flush_open}", lambda: E.merge_events(
            self.extracted(), self.keys, flush_open=flush_open, seg_rows=self.seg_rows))

    def filtered(self) -> DataFrame:
        return self._get("filtered", lambda: self._m(SC.filter_min_action(self.merged())))

    def thresholds(self) -> DataFrame:
        # the historical table is not shipped: medians over the filtered events
        return self._get("thr", lambda: SC.class_thresholds(self.filtered()))

    def classified(self) -> DataFrame:
        return self._get("classified", lambda: SC.classify(self.filtered(), self.thresholds()))

    def scored(self) -> DataFrame:
        return self._get("scored", lambda: SC.score(self.classified()))
