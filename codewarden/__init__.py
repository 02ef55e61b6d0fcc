"""Spark jobs for the data work around source-code vulnerability detection.

Layout
------
``sources``    readers and writers (JSON lines, CSV, archives, predictions)
``functions``  column expressions: text, encodings, probabilities, losses
``operators``  DataFrame to DataFrame steps: cleaning, classes, curves, packing, lines
``plans``      whole jobs built from the operators, and the registered queries
``streaming``  the running quality report as a Structured Streaming job
"""
