"""Operators: functions from a stream to a stream."""
