"""Label models: rules, scored labels, and a classifier fitted with Spark ML."""
