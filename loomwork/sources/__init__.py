"""Readers of crawl artefacts and the chunk store."""
