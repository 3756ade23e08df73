"""What ``__spark_entry__.py`` registers for the panel library."""

from steppe.plans.oracles import ORACLES
from steppe.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
