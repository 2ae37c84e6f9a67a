"""Column expressions: R null/NaN rules, cleaning and coding, pricing columns, objectives."""
