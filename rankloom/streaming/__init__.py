"""Incremental work: micro-batches that skip what is done."""
