"""What ``__spark_entry__.py`` registers for this subpackage."""

from steppe.llm.oracles import ORACLES
from steppe.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
