"""From query text to plans: parser, algebra, normal form, planner."""
