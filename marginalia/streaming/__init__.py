"""The daily poll as an incremental stream."""
