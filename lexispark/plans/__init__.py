"""Query language: syntax tree, parser, planner."""
