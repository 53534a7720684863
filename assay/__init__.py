"""Spark-native evaluation of classifiers and integrity checks of the datasets behind them.

``functions``  column expressions (no jobs, no shuffles)
``operators``  DataFrame -> DataFrame operators
``sources``    readers and writers
``plans``      end-to-end reports and the registered queries with their SQL oracles
"""
