"""Secret scanning as Spark DataFrame transformations."""

from leaksieve.plans.scan import scan_text
from leaksieve.rules import Rule, RuleSet

__all__ = ["Rule", "RuleSet", "scan_text"]
