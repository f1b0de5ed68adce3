"""Survey-panel and text-corpus preparation on Spark DataFrames.

``functions``  Column builders, no shuffle.
``sources``    readers, writers and staged tables.
``operators``  DataFrame -> DataFrame steps.
``plans``      the end-to-end jobs built from them.
``queries``    the operators bound to the test tables, with their SQL twins.
"""
