"""Operators over transcripts: flagging, resolving overrides, review, segments, jobs, audio."""
