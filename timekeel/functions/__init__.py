"""Column expressions: clocks, values, geodesy. No Python UDFs."""
