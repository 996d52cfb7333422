"""Operators for building large text-training corpora. Nothing else in envlake imports this."""
