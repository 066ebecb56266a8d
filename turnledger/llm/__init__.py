"""Operators for training-data pipelines: deduplication, decontamination,
classification, mixing, language identification, rules, token counts, licences.

Nothing else in the library imports this subpackage.  Modules are imported by
executors too, so ship the repository with ``--py-files`` (or have it on
``PYTHONPATH``) on a cluster.
"""
