"""Structured Streaming over access logs."""
from tidegauge.streaming.counts import ScanCounter, observed
from tidegauge.streaming.heads import with_heads_stream
from tidegauge.streaming.paths import path_sketches_stream
from tidegauge.streaming.rates import parsed_stream, per_second_stream, read_stream, tail_lines, wait_histogram_stream

__all__ = ["ScanCounter", "observed", "parsed_stream", "path_sketches_stream", "per_second_stream", "read_stream", "tail_lines", "wait_histogram_stream", "with_heads_stream"]
