"""Training-data operators: packing, deduplication, classifiers, tokenisation.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
from here, so the folder can be removed as a whole.
"""
