"""featherloom: feature engineering, data quality, statistics and forecast analytics as Spark plans."""

from featherloom.session import get_session

__all__ = ["get_session"]
