"""Transcript flagging and redaction analytics on PySpark."""
