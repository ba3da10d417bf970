"""Firm-by-year panel analytics on Spark DataFrames."""

from firmlens.config import PanelConfig
from firmlens.plans.study import PanelStudy

__all__ = ["PanelConfig", "PanelStudy"]
