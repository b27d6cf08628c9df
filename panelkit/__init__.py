"""Panel analytics on Spark: stations observed on a fixed time grid.

Every operator takes DataFrames and returns a lazy DataFrame; see README.md.
"""

from panelkit.config import PanelConfig
from panelkit.session import session, tune

__all__ = ["PanelConfig", "session", "tune"]
