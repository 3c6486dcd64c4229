"""Agent sessions as batch replay and as structured streams."""
