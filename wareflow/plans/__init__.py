"""The reports: parameterised plans over the nine tables, built from the operators."""
