"""Operators that prepare training corpora: packing, deduplication, decontamination, scans, language ID, WARC, chat."""
