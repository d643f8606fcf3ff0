"""citescope: a Spark-native engine for auditing the external citations of web articles.

Layers:
  functions/  column expressions (URL algebra, text cleaning, classifiers' building blocks)
  sources/    readers and writers (page-view documents, saved article lists, pages, report CSV)
  operators/  relational operators (ranking, extraction, pairing, probes, browser, report)
  plans/      composite plans (the full audit) and the query catalog
  streaming/  incremental audit on Structured Streaming
"""

__all__ = ["session", "schemas", "fixtures"]
