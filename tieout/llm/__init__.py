"""Training-data operators: filtering, deduplication, decontamination, mixing and archives.

Nothing else in the library imports this subpackage.  ``llm.queries`` registers
one ``opN_<name>`` query per operator; ``corpus_pipeline.py`` chains five of them.
"""
