"""Readers and writers: lines of JSON, worksheets, articles, standard input."""
