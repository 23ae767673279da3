"""Compositions of operators: insights, chart series, dashboards and the registered queries."""
