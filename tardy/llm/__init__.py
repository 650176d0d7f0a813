"""Training-data operators: one module per operator, plus shared helpers.

Nothing outside this package imports it; ``__spark_entry__.py`` adds the
queries of :mod:`tardy.llm.queries` when the package is present.
"""
