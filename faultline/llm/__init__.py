"""Training-data operators (numbered 1-10) and their registered queries.

Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
