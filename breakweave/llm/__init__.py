"""Operations of a training-data pipeline over documents, pages, embeddings and benchmarks.

Nothing outside this folder imports it; ``queries`` holds what the entry point registers.
"""
