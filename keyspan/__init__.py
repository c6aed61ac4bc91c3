"""Key-event interval analytics as Spark DataFrame operators."""

from keyspan.config import DEFAULT, AnalysisConfig
from keyspan.plans.analysis import Analysis
from keyspan.sources.gaze import as_gaze, gaze_from_pandas, load_gaze

__all__ = ["DEFAULT", "Analysis", "AnalysisConfig", "as_gaze", "gaze_from_pandas", "load_gaze"]
