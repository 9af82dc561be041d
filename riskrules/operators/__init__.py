"""DataFrame -> DataFrame operators of the rule-mining method."""
