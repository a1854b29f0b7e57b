"""Readers and writers: vector text, ground truth, run logs and summaries, drifting JSON."""
