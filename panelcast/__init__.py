"""Point-in-time-safe forecasting on event panels, as PySpark DataFrame operators."""

from panelcast.spec import PanelSpec

__all__ = ["PanelSpec"]
