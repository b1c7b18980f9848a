"""firelake: active-fire analytics expressed as PySpark DataFrame operators.

Sub-packages
    functions   Column -> Column expressions (labels, severity, times, units)
    sources     scans, payload parsers, tables and sinks
    operators   DataFrame -> DataFrame building blocks
    plans       composed jobs (serving, dashboard, features, training)
    streaming   Structured Streaming ingest
    checks      views over the check tables, registered queries and their SQL
"""

__version__ = "0.1.0"
