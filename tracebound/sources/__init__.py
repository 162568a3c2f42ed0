"""Readers that turn raw text, Markdown and HTML into units, and the sinks."""
