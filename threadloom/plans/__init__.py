"""Plans: the registered queries. Importing this package fills the registry."""

from threadloom.plans import core_queries, corpus_queries, decision_queries, evaluation_queries, retrieval_queries, service_queries  # noqa: F401
