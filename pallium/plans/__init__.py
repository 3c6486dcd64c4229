"""Action plans: parsing, validation, rewriting."""
