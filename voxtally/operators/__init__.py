"""DataFrame -> DataFrame operators; use them with ``df.transform``."""
