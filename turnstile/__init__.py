"""Transit crowding analytics as PySpark DataFrame operators.

``functions``  column expressions
``operators``  DataFrame -> DataFrame building blocks, column names as arguments
``sources``    schemas, tables, feeds and the feature log
``streaming``  Structured Streaming jobs
``plans``      whole jobs and the transit preset
``showcase``   every operator run on the test tables, with a SQL twin
"""
