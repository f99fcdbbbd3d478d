"""Operations of a training-data pipeline, one module per operator.

Nothing outside this package imports it. ``llm.registry`` holds the queries and their SQL.
"""
