"""Classifiers. Every fitted model has ``predict(df)``, which adds ``prediction`` and ``probability``.

``probability`` is the probability (or, for margin models, the squashed margin) of class 1 as a double.
"""
