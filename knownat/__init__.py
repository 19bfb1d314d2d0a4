"""Point-in-time panel analytics and early-warning evaluation on Spark DataFrames.

Every operator takes and returns lazy DataFrames and is parameterised by entity, time and value
columns.  ``knownat.scale`` holds the few primitives whose groups may grow without bound (ranks,
exact quantiles, running totals, last-known values); everything else is plain DataFrame algebra.
"""
