"""Runnable queries: every operator applied to the given tables."""


def load():
    """Import all query modules once and return the registry."""
    from verbascope.catalog import registry
    from verbascope.catalog import q_jobs, q_metrics, q_sources, q_speech, q_text, q_training  # noqa: F401

    return registry
