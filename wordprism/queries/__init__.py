"""One registered query per operator, over the given tables."""

from wordprism.queries import sources, text, tokens, sampling, geometry, catalog, select, views, explain, topics  # noqa: F401
