"""Domain plans: views, derivation jobs, reports and data-quality checks."""
