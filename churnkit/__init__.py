"""churnkit - customer-retention analytics on Spark DataFrames.

Subpackages: ``sources`` (tables, fixtures adapter, sinks), ``functions``
(scalar rules and cleaners), ``operators`` (per-user roll-ups, metrics,
sampling, explanations), ``plans`` (feature-matrix assembly, model recipes,
registered queries and their SQL oracles).
"""

__version__ = "0.1.0"
