"""Spark-first engine for security-observation data and training corpora."""

__version__ = "0.1.0"


def open_store(spark, path=None, session_id="session", **options):
    """A session's store; see sightline.plans.store.Store."""
    from .plans.store import Store

    return Store(spark, path, session_id, **options)


def open_async_store(spark, path=None, session_id="session"):
    """The same for asynchronous callers; create() or attach() comes first."""
    from .aio import AsyncStore

    return AsyncStore(spark, path, session_id)
