"""riskrules: readable decision rules learned from labelled transaction tables, on Spark.

Every step is a DataFrame -> DataFrame function built on Spark SQL
expressions and Spark ML, so it runs distributed and stays open to Catalyst.
"""

from .roles import Params, Roles
from .operators.ruleset import choose as choose_ruleset
from .plans.workflow import MiningResult, extract_rules, mine_rules, preprocess

__all__ = ["Params", "Roles", "MiningResult", "mine_rules", "preprocess", "extract_rules", "choose_ruleset"]
