"""Reuse of built column expressions."""

from __future__ import annotations

import functools

from pyspark import SparkContext


def remembered(build):
    """Keep what a zero-argument builder of columns returns, per Spark application.

    Columns are unresolved expressions, so one build serves every plan; building the large ones
    takes thousands of calls into the JVM.
    """
    kept: dict[str, object] = {}

    @functools.wraps(build)
    def get():
        context = SparkContext._active_spark_context
        key = context.applicationId if context else ""
        if key not in kept:
            kept.clear()
            kept[key] = build()
        return kept[key]

    return get
