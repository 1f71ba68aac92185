"""Training-data operators: quality, dedup, decontamination, mixing and formats.

One module per operator, each with its own general interface; ``queries``
holds the registered queries and their SQL.  Nothing outside this package
(and the pipeline script beside it) imports from here.
"""
