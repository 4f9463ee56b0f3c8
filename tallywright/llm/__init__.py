"""Training-data operators: one module each, all on DataFrames.

Nothing else in the package imports this one; its queries are in
``tallywright.llm.queries``.
"""
