"""Column builders: text, checksums, identifier matchers, the category catalog, geometry."""
