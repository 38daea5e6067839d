"""Readers and adapters: the given tables as purchase lines, text history files, sinks."""
