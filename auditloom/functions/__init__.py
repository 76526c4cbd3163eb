"""Column functions."""

from __future__ import annotations

from functools import wraps


def built_once(f):
    """Keep what f(*names) built for the running JVM: columns hold no data and no session, and large ones take seconds to build."""
    held: dict = {}

    @wraps(f)
    def get(*names: str):
        from pyspark import SparkContext

        gateway = SparkContext._gateway
        if held.get("gateway") is not gateway:
            held.clear()
            held["gateway"] = gateway
        if names not in held:
            held[names] = f(*names)
        return held[names]

    return get
