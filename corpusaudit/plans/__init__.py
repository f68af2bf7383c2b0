"""Helpers that shape distributed plans: checkpoints, top-k, row numbers, graph iteration."""
