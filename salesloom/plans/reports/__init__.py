"""Reports: functions from a ``Retail`` model to a DataFrame."""
