"""Log sources: lines in file order."""
from tidegauge.sources.lines import head_lines, one_range, read_files, read_lines, resolve, source_label

__all__ = ["head_lines", "one_range", "read_files", "read_lines", "resolve", "source_label"]
