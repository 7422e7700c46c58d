"""Hybrid document retrieval on Spark: incremental indexes, exact vector and BM25 search, fusion, filters and reranking."""
