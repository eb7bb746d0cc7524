"""Scalar functions over columns: text measures, URL and date parsing, intent tests, HTML to text."""
